"""Story functions, the script parser, lookups, relations and sources on small fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lithos.functions import stories as S
from lithos.functions import text as X
from lithos.operators import corpus, graph, lookups, retrieval, scripts
from lithos.sources import tables


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_chapter_numbers(spark):
    assert values(spark, S.chapter_number(F.col("x")), ["十", "十二", "二十", "二十三", "两", "零", "07", "0", "100", "百", "", None]) == [10, 12, 20, 23, 2, 0, 7, None, None, None, None, None]
    assert values(spark, S.chapter_numbers(F.col("x")), ["第 十三 章和 level_main-05、第13章", "8章 第99章 第0章", None]) == [[13, 5], [8, 99], []]


def test_keys(spark):
    assert values(spark, S.story_key(F.col("x")), [" ./Obt\\Main\\Level_A.txt ", "[UC]info/x.TXT", None]) == ["obt/main/level_a", "x.txt", None]
    assert values(spark, S.stage_of_key(F.col("x")), ["a/level_main_01_beg", "a/story_1", "level__end", "level_"]) == ["main_01", None, None, None]
    assert values(spark, S.zone_name(F.col("x"), F.lit("<b>A</b>"), F.col("x")), ["A", " B ", None, ""]) == ["A", "B A", "A", "A"]


def test_terms_keep_their_digits(spark):
    assert values(spark, X.distinct_terms(F.array("x", F.lit("1a1"), F.lit(" x0 "))), ["0a0", " x0"]) == [["0a0", "1a1", "x0"], ["x0", "1a1"]]
    assert values(spark, X.strip_markers(F.col("x")), ["[CHAIN_LEN=3] a [E12] b [CAUSAL_ORDER=x>y]", "[E] c"]) == ["a b", "[E] c"]


def test_script(spark):
    lines = ["[HEADER(a=1)] Title", '[name="A"] one', '[name="A"]two', "", "plain <i>one</i>", "plain two", '[Dialog(dialogHead="$v")]', "", '[name="B"] three', "said by v", "then nobody", "", "[Sub] \\ tail", '[name="C"]  ', "end"]
    got = [(r.speaker, r.text, r.kind) for r in scripts.parse(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "s long, n int, x string"), "s", "n", "x", {"v": "Vee"}).orderBy("segment").collect()]
    assert got == [
        (None, "Title", "header"), ("A", "one\ntwo", "dialogue"), (None, "plain one plain two", "narration"), ("B", "three", "dialogue"),
        ("Vee", "said by v then nobody", "dialogue"), (None, "tail\nend", "narration"),
    ]
    assert scripts.parse(spark.createDataFrame([], "s long, n int, x string"), "s", "n", "x").count() == 0


def test_chunks_count_every_separator(spark):
    one = lambda *n: spark.createDataFrame([(list(n),)], "x array<int>").select(corpus.pack_chunks(F.col("x"))).first()[0]
    assert [tuple(c) for c in one(200, 219)] == [(0, 0), (0, 1)] and [tuple(c) for c in one(200, 218)] == [(0, 1)]
    seg = spark.createDataFrame([(1, 0, "A", "x" * 300), (1, 1, None, "y" * 200), (1, 2, None, "z")], "story int, segment int, speaker string, text string")
    got = [(r.first, r.last, len(r.text)) for r in scripts.chunks(seg).orderBy("chunk").collect()]
    assert got == [(0, 0, 302), (0, 1, 503), (1, 2, 202)]


def test_speakers_and_topics(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = lookups.speakers(lookups.names(df([("c1", "Amy"), ("c2", " ")], "k string, n string"), "k", "n"), df([("c1", "Ann"), ("n1", "Bo")], "key string, name string"), df([("av", "n1"), ("zz", "none")], "key string, target string"))
    assert {tuple(r) for r in got.collect()} == {("c1", "Ann"), ("n1", "Bo"), ("av", "Bo"), ("$av", "Bo")}
    got = lookups.topics(df([("rogue_1", None, "R"), ("x", "ID", "Y"), ("z", None, " ")], "key string, id string, name string"))
    assert {tuple(r) for r in got.collect()} == {("rogue_1", "R"), ("ro1", "R"), ("id", "Y")}


def test_describe(spark):
    df = spark.createDataFrame
    item = "array<struct<story_txt:string,story_group:string,story_code:string,story_name:string,avg_tag:string,story_sort:int,stages:array<string>>>"
    groups = df([(0, "Act1", "First", [("a/level_x_beg", None, "X-1", "One", "before", 1, ["st_1"]), ("", None, None, None, None, 0, [])])], f"place int, key string, name string, items {item}")
    review, review_stage, review_activity = lookups.reviews(groups)
    t = {
        "review": review, "review_stage": review_stage, "review_activity": review_activity,
        "story": df([("b/other", "id9", "ST_1", "STAGE", None)], "key string, id string, trigger_key string, trigger_type string, required string"),
        "stage": df([("st_1", "zone_1", "1-1", "Stage", "MAIN")], "key string, zone_id string, code string, name string, stage_type string"),
        "zone": df([("zone_1", "Zone")], "key string, zone_name string"), "chapter": df([("zone_1", "c", "Chapter")], "key string, chapter_id string, chapter_name string"),
        "zone_activity": df([("zone_1", "act9")], "key string, activity string"), "activity": df([("act9", "Nine")], "key string, name string"), "topic": df([("ro1", "Rogue")], "key string, name string"),
    }
    got = {r.path: r for r in lookups.describe(df([("A/level_x_beg.txt",), ("b/other.txt",), ("obt/roguelike/ro1/q.txt",), ("lone.txt",)], "path string"), "path", t).collect()}
    a, b, c, d = (got[p] for p in ("A/level_x_beg.txt", "b/other.txt", "obt/roguelike/ro1/q.txt", "lone.txt"))
    assert (a.activity_id, a.activity_name, a.story_name, a.stage_id, a.zone_name, a.chapter_name) == ("Act1", "First", "One", "st_1", "Zone", "Chapter")
    assert (b.story_id, b.activity_id, b.story_code, b.trigger_type, b.stage_code) == ("id9", "Act1", "X-1", "STAGE", "1-1")  # by its stage
    assert (c.activity_id, c.activity_name, c.story_id) == ("ro1", "Rogue", "obt_roguelike_ro1_q.txt") and (d.activity_id, d.stage_id, d.story_key) == (None, None, "lone")


def test_relations(spark):
    rel = spark.createDataFrame([("A", "knows", "B", "s", [7, 8]), ("C", "made", "D", "s", [9])], "head string, relation string, tail string, source string, evidence array<long>")
    edges = spark.createDataFrame([("A", 1, 1, 0), ("B", 2, 1, 0)], "entity string, doc_id long, weight long, first int")
    asked = spark.createDataFrame([("A", 0)], "entity string, pos int")
    got = {r.doc_id: round(r.score, 6) for r in graph.relation_scores(rel, edges, asked, "about A only", [], []).collect()}
    # one end known, no term in common: bonus 1.5, weak evidence 0.45, ends 0.5 each
    assert got == {7: 0.675, 8: 0.3375, 1: 0.5, 2: 0.5}
    got = {r.doc_id: round(r.score, 6) for r in graph.relation_scores(rel, edges, asked, "A and B", [], []).collect()}
    # both ends known: bonus 3, evidence 2.4, ends 0.5 and the bonus
    assert got == {7: 7.2, 8: 3.6, 1: 3.5, 2: 3.5}
    got = {r.doc_id for r in graph.relation_scores(rel, edges, asked, "A", [], [], spark.createDataFrame([(8,), (2,)], "doc_id long")).collect()}
    assert got == {8, 2}
    found = graph.graph_search(edges, asked, 5, rel, "A and B").collect()
    assert [r.doc_id for r in found][:2] == [7, 1] and found[0]["rank"] == 0


def test_aliases(spark):
    names = graph.alias_names(spark.createDataFrame([(0, "X", ["xx", "yy"]), (1, "Y", ["yy", "z", " xx "])], "place int, canonical string, aliases array<string>"))
    assert {tuple(r) for r in names.collect()} == {("xx", "Y"), ("yy", "Y")}
    assert values(spark, graph.alias_entities(F.col("x"), {"ab": "1", "b": "2", "abc": "3", "zz": "1"}), ["zabc", "zz b", "", None]) == [["1", "2", "3"], ["1", "2"], [], []]
    assert set(values(spark, graph.gate_terms(F.col("x"), ["停"], ["关系"]), ["甲乙丙丁 停止 A1 关系x"])[0]) == {"甲乙丙丁", "甲乙", "乙丙", "丙丁", "甲乙丙", "乙丙丁", "关系", "A1", "x"} - {"x"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n[1]\n')
    assert [(r.line, r.value) for r in tables.strict_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == [(1, '{"id": 1}'), (3, '{"id": 2}')]
    with pytest.raises(Exception, match=r"b\.jsonl:2"):
        tables.strict_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    assert [r.value for r in tables.dumps_jsonl(spark.createDataFrame([(1, "x")], "a int, b string")).collect()] == ['{"a":1,"b":"x"}']
    base = spark.createDataFrame([("a", "t")], "id string, search_text string")
    extra = spark.createDataFrame([("b", "late", None, 2), ("b", "first", " ", 1)], "id string, clean_text string, search_text string, n int")
    assert {(r.id, r.search_text) for r in tables.extra_documents(base, extra, "n").collect()} == {("a", "t"), ("b", "first")}
    with pytest.raises(Exception, match="lacks"):
        tables.extra_documents(base, extra.withColumn("clean_text", F.lit(" ")), "n").collect()
    tables.preview(spark.range(500).toDF("x"), "x", str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 200


def test_vote_and_weights(spark):
    hits = spark.createDataFrame([(0, "a"), (1, "bb"), (2, "a"), (3, None), (4, "bb")], "rank int, story string")
    assert [tuple(r) for r in retrieval.story_vote(hits, "story", 4, 3).collect()] == [("a", 6)]
    assert [tuple(r) for r in retrieval.story_vote(hits.where("rank in (0, 1, 4)"), "story", 4, 4).collect()] == [("a", 4)]
    assert retrieval.story_vote(hits, "story", 4, 7).count() == 0
    assert retrieval.graph_weight("detail", 1.0) == 0.25 and retrieval.graph_weight("detail", 1.0, {"detail": 0.5}) == 0.5
