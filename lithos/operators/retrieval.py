"""Scans, fusion and expansion of ranked lists. Ranks are columns; every order ends in an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.text import bm25_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Digits that scores are compared to: sums of floating-point numbers depend on their order.
DIGITS = 6


def ranked(df: DataFrame, by: list[Column], group: list[str] | None = None, k: int | None = None) -> DataFrame:
    """`df` with a 0-based rank, its first k only; grouped top-k is limited before the shuffle."""
    if not group and k is not None:
        df = df.orderBy(*by).limit(k)
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*by)
    out = df.withColumn("rank", F.row_number().over(window))
    if k is not None:
        out = out.where(F.col("rank") <= k)  # on the row number itself, which is what limits rows before the shuffle
    return out.withColumn("rank", F.col("rank") - 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, term, tf, dl)."""
    tokens = docs.select(F.col(key).alias("doc_id"), bm25_tokens(F.col(text)).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf); an idf below zero is EPSILON times the mean idf of all terms."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = postings(docs, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # n: one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean: one row


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int, scope: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of each query, scores over 0 only.

    Statistics are of all documents, also under a scope. Postings are reduced to the
    queries' terms by a join before anything is scored.
    """
    terms = queries.select(F.col(query_key).alias("query_id"), F.explode(bm25_tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    average = docs.agg(F.avg(F.size(bm25_tokens(F.col(text)))).alias("avgdl"))
    idf = bm25_terms(docs, key, text)
    inside = docs if scope is None else docs.where(scope)
    found = postings(inside, key, text).join(terms, "term").join(idf, "term").crossJoin(F.broadcast(average))  # one row
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * weight), DIGITS).alias("score")).where("score > 0")
    return ranked(scored, [F.desc("score"), F.asc("doc_id")], ["query_id"], k)


def dense(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) by inner product in double precision. queries: (query_key, `vector`), few by contract of the caller."""
    product = F.aggregate(F.zip_with(vector, "_q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("_q"))
    scored = vectors.crossJoin(q).select("query_id", F.col(key).alias("vec_id"), F.round(product, DIGITS).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("vec_id")], ["query_id"], k)


def reciprocal_rank_fusion(lists: dict[str, tuple[DataFrame, float]], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(doc_id, fusion_score, <name>_score..., rank). Each list: (doc_id, score, rank) and its weight. One group-by in place of outer joins."""
    all_ = None
    for name, (hits, weight) in lists.items():
        one = hits.select("doc_id", F.lit(name).alias("src"), "score", (F.lit(weight) / (rrf_k + F.col("rank") + 1)).alias("w"))
        all_ = one if all_ is None else all_.unionByName(one)
    kept = [F.max(F.when(F.col("src") == n, F.col("score"))).alias(f"{n}_score") for n in lists]
    fused = all_.groupBy("doc_id").agg(F.round(F.sum("w"), 9).alias("fusion_score"), *kept)
    return ranked(fused, [F.desc("fusion_score"), F.asc("doc_id")], None, k)


def append_supplemental(primary: DataFrame, supplemental: DataFrame, k: int, source: str) -> DataFrame:
    """Primary hits, then unseen supplemental ones in their order with the source's name; k in all."""
    new = supplemental.join(primary.select("doc_id"), "doc_id", "left_anti").select("doc_id", "score", F.lit(1).alias("part"), F.col("rank").alias("at"), F.lit(source).alias("supplemental_source"))
    old = primary.select("doc_id", "score", F.lit(0).alias("part"), F.col("rank").alias("at"), F.lit(None).cast("string").alias("supplemental_source"))
    return ranked(old.unionByName(new), [F.asc("part"), F.asc("at"), F.asc("doc_id")], None, k).select("doc_id", "score", "supplemental_source", "rank")


def merge_ranked(hits: DataFrame, k: int) -> DataFrame:
    """hits: (list, doc_id, score, rank). Sum of 1/(60+rank+1), then matches, best rank and best score decide."""
    merged = hits.groupBy("doc_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank") + 1)), 9).alias("rank_score"), F.count(F.lit(1)).alias("matches"), F.min("rank").alias("best_rank"), F.max("score").alias("max_score"))
    return ranked(merged, [F.desc("rank_score"), F.desc("matches"), F.asc("best_rank"), F.desc("max_score"), F.asc("doc_id")], None, k)


def expand_neighbours(seeds: DataFrame, rows: DataFrame, story: str, place: str, window: int, k: int) -> DataFrame:
    """Seeds (story, place, rank) and the rows of their story within `window` places, in the order they are first met."""
    s = seeds.select(F.col(story).alias("_story"), F.col(place).alias("_place"), "rank")
    near = rows.join(s, (rows[story] == s._story) & rows[place].between(s._place - window, s._place + window))
    off = F.abs(F.col(place) - F.col("_place"))
    met = near.select(story, place, F.struct(F.col("rank"), off.alias("off"), F.col(place).alias("at")).alias("order"))
    return ranked(met.groupBy(story, place).agg(F.min("order").alias("order")), [F.asc("order"), F.asc(story)], None, k).select(story, place, "rank")


def expand_by_rules(seeds: DataFrame, docs: DataFrame, k: int, seeds_used: int = 24, window: int = 2, sort_window: int = 1, sweep: bool = False, sweep_seeds: int = 8, sweep_docs: int = 24) -> DataFrame:
    """Seeds (doc, rank) and their neighbours (doc, rank, source), k in all.

    docs: (doc, story, activity, stage, sort), `doc` an order number; a blank
    story, activity or stage is none. For each of the first `seeds_used` seeds
    follow the rules in turn: passages of its story within `window` places;
    if `sweep`, its story outward from it (the place before comes first);
    passages of its activity and stage; those of its activity within
    `sort_window` of its sort. A passage comes where it is first met.
    """
    by_story = Window.partitionBy("story").orderBy("doc")
    known = docs.withColumn("place", F.when(F.coalesce("story", F.lit("")) != "", F.row_number().over(by_story)))
    names = ["doc", "story", "activity", "stage", "sort", "place"]
    s = seeds.where(F.col("rank") < seeds_used).join(known, "doc").select("rank", *[F.col(c).alias(f"s_{c}") for c in names])
    gap, filled = F.col("place") - F.col("s_place"), lambda c: F.col(c) != ""

    def met(how: Column, rule: int, *order: Column) -> DataFrame:
        pairs = known.join(s, how)
        key = [c.cast("long") for c in order] + [F.lit(0).cast("long")] * (2 - len(order))
        return pairs.select("doc", F.struct(F.col("rank").alias("seed"), F.lit(rule).alias("rule"), key[0].alias("a"), key[1].alias("b")).alias("met"))

    same = lambda c: (F.col(c) == F.col(f"s_{c}")) & filled(c)
    parts = [met(same("story") & F.abs(gap).between(0, window), 0, gap)]
    if sweep:
        near = met(same("story") & (F.col("rank") < sweep_seeds), 1, F.abs(gap), gap)
        one = Window.partitionBy("met.seed").orderBy("met")
        parts.append(near.withColumn("n", F.row_number().over(one)).where(F.col("n") <= sweep_docs).drop("n"))
    parts.append(met(same("activity") & same("stage"), 2, F.col("doc")))
    parts.append(met(same("activity") & (F.abs(F.col("sort") - F.col("s_sort")) <= sort_window), 3, F.col("sort"), F.col("doc")))
    first = reduce(DataFrame.unionByName, parts).groupBy("doc").agg(F.min("met").alias("met"))
    new = first.join(seeds.select("doc"), "doc", "left_anti").select("doc", F.lit(1).alias("part"), "met", F.lit(None).cast("long").alias("at"), F.lit("neighbor").alias("source"))
    old = seeds.select("doc", F.lit(0).alias("part"), F.lit(None).cast(first.schema["met"].dataType).alias("met"), F.col("rank").cast("long").alias("at"), F.lit(None).cast("string").alias("source"))
    return ranked(old.unionByName(new), [F.asc("part"), F.asc("at"), F.asc("met"), F.asc("doc")], None, k).select("doc", "rank", "source")


#: The order in which a hit's scores are looked at.
RAW_SCORES = ["score", "dense_score", "sparse_score", "minirag_score", "fusion_score"]


def first_score(hits: DataFrame, names: list[str]) -> Column:
    """The first of these scores that a hit has; 0 if it has none."""
    return F.coalesce(*[F.col(n).cast("double") for n in names if n in hits.columns], F.lit(0.0))


def keep_order(lists: DataFrame, k: int | None = None) -> DataFrame:
    """lists: (list, rank, doc_id). Each document once, where it is first met, list by list; blank ids are left out."""
    first = lists.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "").groupBy("doc_id").agg(F.min(F.struct("list", "rank")).alias("met"))
    return ranked(first, [F.asc("met"), F.asc("doc_id")], None, k).select("doc_id", "rank")


def max_merge(lists: DataFrame, scores: list[str]) -> DataFrame:
    """lists: (doc_id, scores...). One row for each document with its largest score of each kind."""
    return lists.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in scores])


def story_vote(hits: DataFrame, story: str, items: int, least: int) -> DataFrame:
    """hits: (rank from 0, story). The story with the most votes of the first `items` hits, the first one weighing `items` and the last one 1; the longer name, then the first, wins a tie. No row below `least` votes; blank names have none."""
    votes = hits.where((F.col("rank") < items) & (F.coalesce(F.col(story), F.lit("")) != "")).groupBy(story).agg(F.sum(F.greatest(F.lit(1), items - F.col("rank"))).alias("votes"))
    return ranked(votes, [F.desc("votes"), F.desc(F.length(story)), F.asc(story)], None, 1).where(F.col("votes") >= least).select(story, "votes")


#: How much of its weight the graph keeps, by what a question asks for; the rest keep a quarter.
GRAPH_MODES = {"relation": 1.0, "reveal": 1.0, "causality": 1.0, "fact": 1.0}


def graph_weight(mode: str, weight: float, weights: dict[str, float] | None = None) -> float:
    return weight * ({**GRAPH_MODES, **(weights or {})}).get(mode, 0.25)


def search_pre_rerank(dense_hits: DataFrame, sparse_hits: DataFrame, graph_hits: DataFrame | None, docs: DataFrame | None, k: int, candidates: int, weights: dict[str, float], append: bool = False, **expansion) -> DataFrame:
    """One question's candidates before re-ranking: (doc, rank, source).

    Hits: (doc_id, score, rank). They are fused by weighted reciprocal ranks
    into the `k` best or, if more, `candidates`; with `append`, the graph's hits
    come after the fused others. docs (see `expand_by_rules`) brings neighbours in.
    """
    lists = {"dense": (dense_hits, weights["dense"]), "sparse": (sparse_hits, weights["sparse"])}
    most = max(k, candidates)
    if graph_hits is not None and not append:
        lists["graph"] = (graph_hits, weights["graph"])
    fused = reciprocal_rank_fusion(lists, k if append else most).withColumnRenamed("fusion_score", "score")
    if graph_hits is not None and append:
        fused = append_supplemental(fused, graph_hits, most, "graph")
    seeds = fused.select(F.col("doc_id").alias("doc"), "rank", (F.col("supplemental_source") if "supplemental_source" in fused.columns else F.lit(None).cast("string")).alias("source"))
    if docs is None:
        return seeds
    wide = expand_by_rules(seeds.select("doc", "rank"), docs, most, **expansion)
    return wide.join(seeds.select("doc", F.col("source").alias("own")), "doc", "left").select("doc", "rank", F.coalesce("own", "source").alias("source"))


def dominant_scope(hits: DataFrame, scope: str, ratio: float, depth: int = 40) -> DataFrame:
    """hits: (list, rank, scope). The scope with the largest sum of weight/sqrt(rank+1) (1.25 for list 0, else 1), with its runner-up's ratio; no row unless it has three votes and either the ratio or six votes."""
    weight = F.when(F.col("list") == 0, 1.25).otherwise(1.0) / F.sqrt(F.col("rank") + 1)
    votes = hits.where((F.col("rank") < depth) & F.col(scope).isNotNull()).groupBy(scope).agg(F.round(F.sum(weight), DIGITS).alias("score"), F.count(F.lit(1)).alias("votes"))
    two = ranked(votes, [F.desc("score"), F.asc(scope)], None, 2)
    pair = two.withColumn("second", F.lead("score").over(Window.partitionBy(F.lit(0)).orderBy("rank"))).where("rank = 0")
    edge = F.round(F.col("score") / F.coalesce(F.col("second"), F.lit(1e-6)), DIGITS)
    fails = (F.coalesce(F.col("second"), F.lit(0.0)) > 0) & (edge < ratio) & (F.col("votes") < 6)
    return pair.withColumn("edge", edge).where((F.col("votes") >= 3) & ~fails).select(scope, "score", "votes", "edge")
