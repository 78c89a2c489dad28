from pyspark.sql import functions as F

from lithos.operators import chains

SCHEMA = "query int, id long, base double, roles array<string>, q_terms array<string>, b_terms array<string>, chain_terms array<string>, story string, activity string, stage string, sort int, stage_no int, background boolean, commits boolean"


def item(i, roles, story="s", activity="a", q=(), b=(), base=1.0, sort=None, stage_no=None, background=False):
    return (0, i, base, roles, list(q), list(b), list(b), story, activity, None, sort, stage_no, background, False)


def test_links(spark):
    rows = [item(1, [], sort=1, stage_no=1), item(2, [], sort=3, stage_no=2), item(3, [], story="", activity=""), item(4, [], story="t", background=True), item(5, [], story="u", background=True)]
    x = spark.createDataFrame(rows, SCHEMA).select("id", F.struct(*chains.ITEM).alias("item"))
    got = {(r.a, r.b): r.v for r in x.alias("x").join(x.alias("y"), F.expr("x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), chains.link_score(F.col("x.item"), F.col("y.item")).alias("v")).collect()}
    assert got[1, 2] == 0.91  # story .45, activity .2, order .12, stage .14
    assert got[1, 3] == 0.0  # empty fields match nothing
    assert got[4, 5] == 0.0  # two background texts of different stories


def test_strict_chain_needs_an_outcome(spark):
    rows = [item(1, ["action"], q=["killer"], base=2.0), item(2, ["outcome"]), item(3, ["context"], story="z", activity="z")]
    got = chains.strict_chains(spark.createDataFrame(rows, SCHEMA), "query").collect()
    assert {(r.seed, tuple(sorted(m.id for m in r.members))) for r in got} == {(1, (1, 2)), (2, (1, 2))}
    bonus = {r.id: r.bonus for r in chains.chain_bonus(chains.strict_chains(spark.createDataFrame(rows, SCHEMA), "query"), "query").collect()}
    assert set(bonus) == {1, 2}
    assert chains.strict_chains(spark.createDataFrame(rows[:1], SCHEMA), "query").count() == 0


def test_no_candidates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chains.strict_chains(none, "query").count() == chains.generic_chains(none, "query").count() == 0


def test_model_scores_keep_the_largest(spark):
    rows = [item(1, ["action", "outcome"]), item(2, ["motive"])]
    scored = chains.generic_chains(spark.createDataFrame(rows, SCHEMA), "query").withColumn("adjusted", F.lit(1.0)).withColumn("overlap", F.lit(0.5))
    got = {r.id: round(r.chain_score, 6) for r in chains.model_bonus(scored, "query", "adjusted", True).collect()}
    assert got == {1: round(0.35 + 0.25 + 0.25 * (0.14 + 0.23) + 0.5, 6), 2: round(0.35 + 0.25 + 0.25 * 0.17 + 0.5, 6)}


def test_focus(spark):
    row = spark.range(1).select(
        chains.chapter_focus(F.lit(3), F.lit(3)).alias("hit"), chains.chapter_focus(F.lit(4), F.lit(3)).alias("miss"), chains.chapter_focus(F.lit(None).cast("int"), F.lit(3)).alias("none"),
        chains.source_focus(F.lit("profile"), False, False, True).alias("profile"), chains.source_focus(F.lit("x"), False, False, True, F.lit(2.0)).alias("reveal"),
        chains.causal_focus(F.lit("they kill"), F.lit(0.0), ["victoria"], ["kill"]).alias("alone"), chains.final_score(F.lit(1.0), F.lit(9.0)).alias("capped"), chains.final_score(F.lit(1.0), F.lit(None).cast("double")).alias("plain"),
    ).first()
    assert (row.hit, row.miss, row.none, row.profile, row.reveal, row.capped, row.plain) == (3.0, -2.5, 0.0, -3.0, 2.7, 4.5, 1.0)
    assert round(row.alone, 6) == -0.67
