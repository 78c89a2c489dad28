"""Links among the members of hash buckets, without all pairs of a large bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed
from lithos.llm.components import connected_components

#: Members of a bucket up to which those that its first one leaves apart meet at once (at most 105 pairs).
SMALL = 16
#: Members of a larger bucket that all others are compared with.
LEADERS = 4
#: Longs of a bitmap of classes.
MARK_WORDS = 8


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, id), each once, without the buckets of one id. One pass: a row waits for the next at most."""
    names = ["bucket", "id", "size"]
    held, last = None, None  # a bucket's first row that waits for a second; the last row seen
    for b in batches:
        bucket, ident, size = (b.column(n).to_numpy() for n in names)
        if held is not None:
            bucket, ident, size = (np.concatenate([x, y]) for x, y in zip(held, (bucket, ident, size), strict=True))
        if not len(bucket):
            continue
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
        if held is None and last is not None:
            fresh[0] = (bucket[0], ident[0]) != last
        known = last[0] if held is None and last is not None else None
        last = bucket[-1], ident[-1]
        bucket, ident, size = bucket[fresh], ident[fresh], size[fresh]
        held = None
        if not len(bucket):
            continue
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        n = np.diff(edge)
        good = np.repeat(n > 1, n)
        if known is not None and bucket[0] == known:
            good[: n[0]] = True
            alone = len(n) > 1 and n[-1] == 1
        else:
            alone = n[-1] == 1
        if alone:
            held = bucket[-1:], ident[-1:], size[-1:]
            good[-1] = False
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (bucket, ident, size)], names)


def bucket_members(entries: DataFrame) -> DataFrame:
    """entries: (bucket, id, size) of type long, any number of times. Those of buckets with two ids or more, once each.

    One shuffle and a sort that can spill; a bucket of any size is read as a stream.
    """
    return entries.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_several, "bucket long, id long, size long")


def _ends(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    groups = connected_components(links, "a", "b")
    return members.join(groups, members.id == groups.node, "left").withColumn("root", F.coalesce("component", "id")).drop("node", "component")


def _still_open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the bucket's number of rows."""
    open_ = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
    return rows.drop("n").join(open_, "bucket")


def lacking(x: str, y: str) -> str:
    """SQL: classes that x has and y lacks, by their bitmaps `marks` (arrays of MARK_WORDS longs)."""
    return "(" + " + ".join(f"bit_count({x}.marks[{j}] & ~{y}.marks[{j}])" for j in range(MARK_WORDS)) + ")"


def bucket_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], may: str, known: Callable[[DataFrame], DataFrame] | None = None, rule: str = "true", decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) of linked ids, enough to connect all ids that links inside buckets connect.

    members: what `bucket_members` returns, written. `verify(pairs)` returns
    those of the distinct (a, b) that are linked. `may`: a condition on the
    sizes `p` and `q` of two ids without which they can't be linked; it holds
    for buckets of every size.

    First each bucket's members are compared with the one of them that is in
    most buckets, and so most central; that connects nearly all that is
    connected, with a pair for each member. Where a larger bucket stays open,
    LEADERS - 1 further ones are compared with all. What is still not
    connected is compared pair by pair. `known(ids)` may give (id, ...), and
    `rule` a condition on such columns of x and y that any two of these ids
    that are linked fulfil: what it rules out is ruled out without loss. Nothing is capped.

    `decide`, in place of `known` and `rule`, gets these open buckets as
    (bucket, id, size, root) and returns links (a, b) that connect what links
    between two roots of a bucket connect; so no row is made of other pairs.
    """
    degree = members.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    order = Window.partitionBy("bucket").orderBy(F.desc("degree"), "id")
    placed = members.join(degree, "id").withColumn("place", F.row_number().over(order) - 1)
    placed = checkpointed(placed.withColumn("leader", F.first("id").over(order)).withColumn("leader_size", F.first("size").over(order)).drop("degree"))

    def fits(p: str, q: str) -> str:
        return "(" + may.replace("{p}", p).replace("{q}", q) + ")"

    pairs = placed.where("id != leader and " + fits("size", "leader_size")).select(*_ends("id", "leader")).distinct()
    links = checkpointed(verify(pairs))
    rest = checkpointed(_still_open(_rooted(placed.where("place > 0").select("bucket", "id", "size", "place"), links)))
    large = rest.where(f"n > {SMALL}")
    if not large.isEmpty():
        leaders = large.where(f"place < {LEADERS}").select("bucket", F.col("id").alias("leader"), F.col("size").alias("leader_size"), F.col("place").alias("at"), F.col("root").alias("leader_root"))
        pairs = large.join(leaders, "bucket").where("place > at and root != leader_root and " + fits("size", "leader_size"))
        more = checkpointed(verify(pairs.select(*_ends("id", "leader")).distinct()))
        links = links.union(more)
        rest = checkpointed(_still_open(_rooted(rest.select("bucket", "id", "size", "place", "n"), links)))
        # the leaders of a large bucket have been compared with all of it
        rest = rest.where(f"place >= {LEADERS} or n <= {SMALL}")
    if decide is not None:
        return links.union(decide(rest.select("bucket", "id", "size", "root")))
    columns, shared = ["bucket", "id", "size", "root"], ""
    if known is not None:
        rest = checkpointed(rest.join(known(rest.select("id").distinct()), "id", "left"))
        columns += [c for c in rest.columns if c not in (*columns, "place", "n")]
        shared = f" and coalesce({rule}, true)"
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    rest = rest.select(*columns).repartition(tasks, "bucket")
    x, y = rest.alias("x"), rest.alias("y")
    far = x.join(y, F.expr("x.bucket = y.bucket and x.id < y.id and x.root != y.root and " + fits("x.size", "y.size") + shared))
    return links.union(verify(far.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()))
