import glob
import os

import duckdb
import pytest

from lithos.operators.evidence import repair_json
from lithos.plans import catalogue, stories  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_mmr_gives_distinct_documents(spark):
    rows = catalogue.mmr_select(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0


@pytest.mark.parametrize(
    ("text", "want"),
    [('x ```json\n{"a": 1,}\n```', '{"a": 1}'), ('{a: [1, 2', '{"a": [1, 2]}'), ('{"a": "b', '{"a": "b"}'), ("none", None), (None, None)],
)
def test_repair_json(text, want):
    assert repair_json(text) == want
