"""Evidence chains among a query's candidates, and re-ranking by them.

A query's candidates are a top-k list (120 at most by contract), so pairs are
made inside a query only. Lexicons are parameters. An item has the columns of
ITEM; `items` adds those that come from its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.text import hits

ITEM = ["id", "base", "roles", "q_terms", "b_terms", "chain_terms", "story", "activity", "stage", "sort", "stage_no", "background", "commits"]

# Weights and limits of links, chains and bonuses.
ROLE_WEIGHTS = {"action": 0.35, "outcome": 0.30, "motive": 0.25, "target": 0.18, "context": 0.12}
MEMBER_WEIGHTS = {"action": 0.12, "outcome": 0.11, "motive": 0.10}
STRICT_SEEDS, STRICT_LINK, STRICT_SIZE = 24, 0.4, 8
GENERIC_SEEDS, GENERIC_LINK, GENERIC_SIZE = 32, 0.25, 5


def present(text: Column, terms: list[str]) -> Column:
    """The terms that the text has, in their order; of a null text, none."""
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in terms]).cast("array<string>"))


def evidence_roles(text: Column, q_terms: Column, b_terms: Column, asked: list[str], motive: list[str], outcome: list[str], target: list[str], background: Column | None = None, answerability: Column | None = None) -> Column:
    """Roles of a text, in alphabetical order: action, context, motive, outcome, target.

    `asked`: the action words of the question. `background`: a source that
    gives context alone. `answerability`: a score by which a text that reveals
    an answer takes further roles.
    """
    q, b = F.size(q_terms), F.size(b_terms)
    some = (q + b) > 0
    plain, score = ~F.coalesce(background, F.lit(False)) if background is not None else F.lit(True), F.coalesce(answerability, F.lit(0.0)) if answerability is not None else F.lit(0.0)
    tests = {
        "action": plain & ((hits(text, asked) > 0) | (q >= 3) | (score >= 3.5)),
        "context": (plain & (b >= 2)) | (~plain & some),
        "motive": plain & (((hits(text, motive) > 0) & some) | (score >= 2.5)),
        "outcome": plain & (((hits(text, outcome) > 0) & some) | (score >= 1.5)),
        "target": plain & (hits(text, target) > 0) & (b > 0),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for r, t in tests.items()]))


def link_score(x: Column, y: Column) -> Column:
    """How closely two items (structs of ITEM) belong together, 0 to 1. Empty or null fields match nothing."""

    def same(field: str) -> Column:
        return F.coalesce((x[field] == y[field]) & (x[field] != ""), F.lit(False))

    def gap(field: str) -> Column:
        return F.abs(x[field] - y[field])

    stories = F.coalesce(x["story"], F.lit("")) != F.coalesce(y["story"], F.lit(""))
    loose = F.coalesce(x["background"] & y["background"], F.lit(False)) & stories
    activity = 0.2 + F.when(same("stage"), 0.25).otherwise(0.0) + F.when(gap("sort") <= 1, 0.25).when(gap("sort") <= 3, 0.12).otherwise(0.0) + F.when(gap("stage_no") == 0, 0.22).when(gap("stage_no") == 1, 0.14).otherwise(0.0)
    shared = F.least(F.size(F.array_intersect(x["chain_terms"], y["chain_terms"])), F.lit(3)) * 0.08
    total = F.when(same("story"), 0.45).otherwise(0.0) + F.when(same("activity") & ~loose, activity).otherwise(0.0) + shared
    return F.round(F.least(F.lit(1.0), total), 6)


def _members(items: DataFrame, seeds: DataFrame, query: str, least: float, keep: int, order: list[Column]) -> DataFrame:
    """(query, seed, place, members): of each seed its `keep` best linked items, itself among the candidates."""
    pairs = seeds.select(query, F.col("item").alias("seed"), "place").join(items, query)
    own = F.col("seed.id") == F.col("item.id")
    pairs = pairs.withColumn("own", own).withColumn("link", F.when(own, 1.0).otherwise(link_score(F.col("seed"), F.col("item")))).where(F.col("link") >= least)
    w = Window.partitionBy(query, "seed.id").orderBy(*order, "item.id")
    kept = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    out = kept.groupBy(query, F.col("seed.id").alias("seed"), "place").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("m"))
    return out.select(query, "seed", "place", F.transform("m", lambda x: x["item"]).alias("members"))


def _seeds(items: DataFrame, query: str, where: Column, order: list[Column], keep: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(*order, "item.id")
    return items.where(where).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def _union(field: str) -> Column:
    return F.array_distinct(F.flatten(F.transform("members", lambda x: x[field])))


def _size(field: str) -> Column:
    return F.size(F.col("item")[field])


def strict_chains(items: DataFrame, query: str) -> DataFrame:
    """(query, seed, members, roles, score): chains in which an action has an outcome or a target, or a motive an outcome.

    No candidates, or none that link up in such roles, give no rows. Ties go to the smaller id.
    """
    packed = items.select(query, F.struct(*ITEM).alias("item"))
    seeds = _seeds(packed, query, (_size("roles") > 0) | (_size("q_terms") >= 2) | (_size("b_terms") >= 2), [F.desc("item.base")], STRICT_SEEDS)
    found = _members(packed, seeds, query, STRICT_LINK, STRICT_SIZE, [_size("roles").desc(), F.desc("link"), _size("b_terms").desc(), F.desc("item.base")])
    found = found.withColumn("roles", _union("roles"))
    has = {r: F.array_contains("roles", r) for r in ROLE_WEIGHTS}
    found = found.where((F.size("roles") >= 2) & F.when(has["action"], has["outcome"] | has["target"]).otherwise(has["motive"] & has["outcome"]))
    pairs = F.flatten(F.transform("members", lambda x: F.transform(F.filter("members", lambda y: y["id"] > x["id"]), lambda y: link_score(x, y))))
    links = found.withColumn("links", pairs)
    average = F.when(F.size("links") > 0, F.aggregate("links", F.lit(0.0), lambda s, v: s + v) / F.size("links")).otherwise(0.0)
    roles = reduce(Column.__add__, [F.when(has[r], w).otherwise(0.0) for r, w in ROLE_WEIGHTS.items()])
    roles = roles + F.when(has["action"] & has["outcome"], 0.25).otherwise(0.0) + F.when(has["action"] & has["motive"], 0.18).otherwise(0.0)
    cover = F.least(F.size(_union("q_terms")), F.lit(8)) * 0.04 + F.least(F.size(_union("b_terms")), F.lit(6)) * 0.06
    score = roles + cover + average * 0.45 + F.least(F.size("members"), F.lit(5)) * 0.03
    return links.select(query, "seed", "members", F.sort_array("roles").alias("roles"), F.round(score, 6).alias("score"))


def generic_chains(items: DataFrame, query: str) -> DataFrame:
    """(query, seed, members, roles, score): chains of two to five linked items, whatever their roles; each set of members once."""
    roles = F.when((F.size("roles") == 0) & (F.size("q_terms") + F.size("b_terms") > 0), F.array(F.lit("context"))).otherwise(F.col("roles"))
    packed = items.withColumn("roles", roles).select(query, F.struct(*ITEM).alias("item"))
    order = [_size("q_terms").desc(), _size("b_terms").desc(), _size("roles").desc(), F.desc("item.base")]
    seeds = _seeds(packed, query, (_size("q_terms") > 0) | (_size("b_terms") > 0) | (F.col("item.base") > 0), order, GENERIC_SEEDS)
    found = _members(packed, seeds, query, GENERIC_LINK, GENERIC_SIZE, [F.desc("own"), F.desc("link"), *order]).where(F.size("members") >= 2)
    found = found.withColumn("set", F.sort_array(F.transform("members", lambda x: x["id"])))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(query, "set").orderBy("place"))).where("n = 1").withColumn("roles", _union("roles"))
    cover = F.least(F.size(_union("q_terms")), F.lit(8)) * 0.12 + F.least(F.size(_union("b_terms")), F.lit(6)) * 0.08
    mean = F.aggregate("members", F.lit(0.0), lambda s, x: s + x["base"]) / F.size("members")
    score = cover + F.least(F.size("roles"), F.lit(4)) * 0.05 + mean * 0.1
    return found.select(query, "seed", "members", F.sort_array("roles").alias("roles"), score.alias("score"))


def chain_bonus(chains: DataFrame, query: str, best: int = 3, decay: float = 0.85, cap: float = 1.25) -> DataFrame:
    """(query, id, bonus): of the members of a query's best chains that carry a chain, the largest bonus."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), "seed")
    top = chains.withColumn("n", F.row_number().over(w)).where(F.col("n") <= best)
    one = top.select(query, "score", "n", F.explode("members").alias("item"))
    has = {r: F.array_contains("item.roles", r) for r in ROLE_WEIGHTS}
    exact = F.exists("item.q_terms", lambda t: F.length(t) >= 4)
    carries = has["target"] | has["outcome"] | (has["action"] & exact) | (has["motive"] & (_size("b_terms") >= 2) & F.coalesce(F.col("item.commits"), F.lit(False)))
    own = reduce(Column.__add__, [F.when(has[r], w_).otherwise(0.0) for r, w_ in MEMBER_WEIGHTS.items()], 0.08 * _size("roles"))
    bonus = F.least("score", F.lit(cap)) * F.pow(F.lit(decay), F.col("n") - 1) + own
    return one.where(carries).groupBy(query, F.col("item.id").alias("id")).agg(F.round(F.max(bonus), 6).alias("bonus"))


def chapter_focus(chapter: Column, asked: Column) -> Column:
    """What a document's chapter adds to its score, if the question names one."""
    return F.when(chapter == asked, 3.0).when(chapter != asked, -2.5).otherwise(0.0)


def source_focus(kind: Column, background: bool, detail: bool, reveal: bool, answerability: Column | None = None) -> Column:
    """What the type of a source (background, story, profile, ...) adds, by what the question asks for."""
    total = F.lit(0.0)
    if background:
        total = F.when(kind == "background", 0.8)
        if detail:
            total = total.when(kind == "story", 0.8)
        total = total.otherwise(0.0)
    elif detail:
        total = F.when(kind == "story", 0.8).when(kind == "background", -1.1).otherwise(0.0)
    if reveal:
        score = F.coalesce(answerability, F.lit(0.0)) if answerability is not None else F.lit(0.0)
        total = total + F.when(score > 0, score * 1.35).when(kind == "profile", -3.0).otherwise(0.0)
    return total


def causal_focus(text: Column, bonus: Column, long_terms: list[str], actions: list[str]) -> Column:
    """What exact terms (five characters or more) and action words of the question add, or cost a text that is in no chain."""
    if not long_terms and not actions:
        return F.lit(0.0)
    exact, acts, alone = hits(text, long_terms) > 0, hits(text, actions) > 0, F.coalesce(bonus, F.lit(0.0)) <= 0
    parts = [F.when(exact, 1.05), F.when(exact & acts, 0.35), F.when(acts & ~exact & alone, -0.22)]
    parts += [F.when(alone & ~exact, -0.45)] if long_terms else []
    parts += [F.when(alone & ~acts, -0.2)] if actions else []
    return reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) for p in parts])


def final_score(score: Column, chain: Column) -> Column:
    """A model's score of the document's chain counts from -1.5 to 3.5."""
    return score + F.when(chain.isNull(), 0.0).otherwise(F.least(F.greatest(chain, F.lit(-1.5)), F.lit(3.5)))


def model_bonus(chains: DataFrame, query: str, adjusted: str, low: bool, overlap: str = "overlap", best: int = 80) -> DataFrame:
    """(query, id, chain_score): a model's scores of chains (column `adjusted`), blended with place, roles and overlap; the largest of each member.

    `low`: fact and relation questions trust the model less.
    """
    w = Window.partitionBy(query).orderBy(F.desc(adjusted), "seed")
    top = chains.withColumn("n", F.row_number().over(w)).where(F.col("n") <= best)
    one = top.select(query, adjusted, overlap, "n", F.explode("members").alias("item"))
    own = reduce(Column.__add__, [F.when(F.array_contains("item.roles", r), v).otherwise(0.0) for r, v in MEMBER_WEIGHTS.items()], 0.07 * _size("roles"))
    a, b, c = (0.35, 0.25, 0.25) if low else (0.45, 0.45, 1.0)
    score = a * F.col(adjusted) + b / F.col("n") + c * own + F.col(overlap)
    return one.groupBy(query, F.col("item.id").alias("id")).agg(F.max(score).alias("chain_score"))
