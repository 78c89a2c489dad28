"""Selecting, ordering and rendering evidence; grounding of quotes and tokens; votes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.stories import strip
from lithos.functions.text import distinct_terms, hits, jaccard, match_form, strip_markers
from lithos.operators.retrieval import ranked

NEAR, MMR_LAMBDA = 0.82, 0.72


def near_duplicates(items: Column, threshold: float = NEAR) -> Column:
    """items: array of (id, tokens) in rank order. Those that are not near any one kept before."""
    kept = F.array().cast("array<struct<id:bigint,tokens:array<string>>>")
    return F.aggregate(items, kept, lambda s, x: F.when(F.exists(s, lambda y: jaccard(y.tokens, x.tokens) >= threshold), s).otherwise(F.concat(s, F.array(F.struct(x.id.alias("id"), x.tokens.alias("tokens"))))))


def mmr(candidates: DataFrame, query: str, k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """candidates: (query, doc_id, score, tokens). k of each query by maximal marginal relevance, with their order.

    Each choice depends on those before, so a query's candidates, which top-k has bounded, are one pandas group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        span = pdf.score.max() - pdf.score.min()
        norm = (pdf.score - pdf.score.min()) / span if span > 1e-9 else pdf.score * 0 + 1.0
        sets, nearest, left, out = [set(t) for t in pdf.tokens], [0.0] * len(pdf), list(range(len(pdf))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (round(weight * norm[i] - (1 - weight) * nearest[i], 9), -i))
            out.append(best)
            left.remove(best)
            for i in left:
                if sets[i] and sets[best]:
                    nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / len(sets[i] | sets[best]))
        return pd.DataFrame({query: pdf[query].iloc[0], "doc_id": pdf.doc_id.iloc[out].to_numpy(), "position": range(len(out))})

    kind = candidates.schema[query].dataType.simpleString()
    return candidates.select(query, "doc_id", "score", "tokens").groupBy(query).applyInPandas(choose, f"{query} {kind}, doc_id long, position int")


def bundle_score(text: Column, core: list[str], bundle: list[str]) -> Column:
    core_hits = hits(text, core)
    return F.when((core_hits == 0) & F.lit(bool(core)), 0).otherwise(3 * core_hits + hits(text, bundle))


def within_budget(blocks: DataFrame, group: list[str], order: str, size: str, budget: int) -> DataFrame:
    """The blocks before the first that would exceed the budget; the first block always stays."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("used", F.sum(size).over(w)).withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def pyramid(rank: Column) -> Column:
    """Order key by which the second comes last."""
    return F.when(rank == 1, F.lit(2**31 - 1)).otherwise(rank)


def ground_quotes(quotes: DataFrame, quote: str, evidence: DataFrame, text: str) -> DataFrame:
    """Quotes with the documents that have them, white space aside. The quotes are few by contract (a model's answer)."""
    q = quotes.withColumn("_q", match_form(F.col(quote))).where("_q != ''")
    return evidence.withColumn("_e", match_form(F.col(text))).join(q, F.expr("contains(_e, _q)")).drop("_e", "_q")


def ungrounded(answer: Column, evidence: Column) -> tuple[Column, Column]:
    """(tokens of an answer, those of three or more characters that the evidence lacks)."""
    return answer, F.filter(answer, lambda t: (F.length(t) >= 3) & ~evidence.contains(t))


def vote(samples: DataFrame, group: str, action: str, ties: list[str]) -> DataFrame:
    """The most frequent action of each group; ties in the given order."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in ties]), F.col(action)), F.lit(0))
    n = samples.groupBy(group, action).agg(F.count(F.lit(1)).alias("votes")).withColumn("_p", F.when(place == 0, len(ties) + 1).otherwise(place))
    w = Window.partitionBy(group).orderBy(F.desc("votes"), "_p", action)
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


# The order in which an item's scores are looked at, and how far a profile page stands back in a prompt.
EVIDENCE_SCORES = ["evidence_chain_score", "evidence_chain_model_score", "rerank_score", "fusion_score", "dense_score", "sparse_score", "score"]
BACKGROUND_COST = 6.0
#: Facts, quotes of a fact, characters of a quote, of a fact's and of an answer's.
QUOTE_LIMITS = {"facts": 6, "refs": 2, "quote": 80, "fact": 160, "answer": 400}


def identity(doc_id: Column, index: Column, text: Column) -> Column:
    """By which evidence is one: its document's id, else its number, else the head of its text."""
    return F.coalesce(F.concat(F.lit("doc:"), F.nullif(strip(doc_id), F.lit(""))), F.concat(F.lit("idx:"), index.cast("string")), F.concat(F.lit("text:"), F.substring(F.coalesce(text, F.lit("")), 1, 160)))


def evidence_text(*parts: Column) -> Column:
    """The distinct parts without markers, one below the other; blank and null ones are left out."""
    return F.array_join(distinct_terms(F.transform(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), strip_markers)), "\n")


def prompt_score(score: Column, background: Column) -> Column:
    return score - F.when(F.coalesce(background, F.lit(False)), BACKGROUND_COST).otherwise(0.0)


def _distinct_items(items: DataFrame, query: str, order: list[str], threshold: float) -> DataFrame:
    """items: (query, id, tokens, ...). In `order`, each id once, without those near one before; with their place `n`."""
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(query, "id").orderBy(*order))).where("_n = 1").drop("_n")
    listed = first.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(*order, F.col("id"), F.col("tokens")))).alias("x"))  # top-k lists by contract
    kept = listed.select(query, F.posexplode(near_duplicates(F.transform("x", lambda i: F.struct(i["id"].alias("id"), i["tokens"].alias("tokens"))), threshold)).alias("n", "k"))
    return kept.select(query, "n", F.col("k.id").alias("id"))


def prompt_top_k(items: DataFrame, query: str, k: int) -> DataFrame:
    """items: (query, id, pos, tokens, score). The k best by score (then place) of those that are not near an earlier one."""
    kept = _distinct_items(items, query, ["pos"], NEAR).join(items.select(query, "id", "score").groupBy(query, "id").agg(F.max("score").alias("score")), [query, "id"])
    return ranked(kept, [F.desc("score"), F.asc("n")], [query], k).select(query, "id", "score", "rank")


def forced_merge(items: DataFrame, query: str, limit: int) -> DataFrame:
    """items: (query, part, pos, id, tokens); part 0 is forced. Forced ones first, then the others, without near copies; `limit` in all."""
    return _distinct_items(items, query, ["part", "pos"], NEAR).where(F.col("n") < limit).select(query, "id", F.col("n").alias("rank"))


def trace_summary(evidence: DataFrame, query: str, rank: str, text: str, keep: int = 3, chars: int = 80) -> DataFrame:
    """The first `keep` of each query with a snippet of their text."""
    snippet = F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, chars)
    return evidence.where(F.col(rank) < keep).withColumn("snippet", snippet).drop(text)


def quote_issues(facts: Column, evidence: Column) -> Column:
    """What is wrong with an answer's facts (array of (fact, quotes: array of strings)) given the evidence's text; an empty array if nothing is.

    Quotes are looked for without white space and markers. Facts and quotes are numbered from 1.
    """
    pool, n = match_form(strip_markers(F.coalesce(evidence, F.lit("")))), QUOTE_LIMITS
    s = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    if_ = lambda test, *parts: F.when(test, F.concat(*parts))

    def of_fact(fact: Column, i: Column) -> Column:
        name = F.concat(F.lit("supported_fact_"), s(i + 1))
        quotes = F.transform(F.coalesce(fact["quotes"], none), lambda q: strip(F.coalesce(q, F.lit(""))))

        def of_quote(q: Column, j: Column) -> Column:
            ref = F.concat(name, F.lit("_ref_"), s(j + 1))
            found = F.array(if_(F.length(q) > n["quote"], ref, F.lit(f"_quote_over_{n['quote']}")), if_(~pool.contains(match_form(strip_markers(q))), ref, F.lit("_quote_not_found")))
            return F.when(q == "", F.array(F.concat(ref, F.lit("_missing_quote")))).otherwise(F.array_compact(found))

        total = F.aggregate(quotes, F.lit(0), lambda a, q: a + F.length(q))
        many = if_(F.size(quotes) > n["refs"], name, F.lit("_too_many_quotes:"), s(F.size(quotes)), F.lit(f">{n['refs']}"))
        long = if_(total > n["fact"], name, F.lit(f"_quote_total_over_{n['fact']}"))
        all_ = F.concat(F.array(many), F.flatten(F.transform(quotes, of_quote)), F.array(long))
        return F.when(F.size(quotes) == 0, F.array(F.concat(name, F.lit("_missing_evidence_refs")))).otherwise(F.array_compact(all_))

    every = F.flatten(F.transform(facts, lambda f: F.filter(F.transform(F.coalesce(f["quotes"], none), lambda q: strip(F.coalesce(q, F.lit("")))), lambda q: q != "")))
    chars = F.aggregate(every, F.lit(0), lambda a, q: a + F.length(q))
    some = F.concat(
        F.array(if_(F.size(facts) > n["facts"], F.lit("too_many_supported_facts:"), s(F.size(facts)), F.lit(f">{n['facts']}"))),
        F.flatten(F.transform(facts, of_fact)),
        F.array(if_(F.size(every) == 0, F.lit("missing_quotes")), if_(chars > n["answer"], F.lit(f"answer_quote_total_over_{n['answer']}:"), s(chars))),
    )
    return F.when(F.coalesce(F.size(facts), F.lit(0)) <= 0, F.array(F.lit("missing_supported_facts"))).otherwise(F.array_compact(some))


def final_answer(action: Column, answer: Column, clarification: Column, round_: Column, rounds: int) -> Column:
    """The answer with which a round ends the loop, or null if it goes on."""
    last = F.when(round_ >= rounds, F.coalesce(F.nullif(answer, F.lit("")), F.lit("现有检索证据不足以确认。")))
    return F.when(action.isin("answer_directly", "abstain"), answer).when(action == "clarify_user", clarification).otherwise(last)


def repair_json(text: str | None) -> str | None:
    """The first JSON object of a model's answer: fenced or bare, closed where it breaks off, keys quoted, stray commas out; null if there is none."""
    if not text or "{" not in text:
        return None
    fence = re.search(r"```(?:json)?\s*(\{.*?)(?:```|\Z)", text, re.S)
    body = fence[1] if fence else text[text.index("{") :]
    stack, quoted, escaped, end = [], False, False, len(body)
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                end = i + 1
                break
    body = body[:end] + '"' * quoted
    body = re.sub(r"[,:\s]+$", "", body) if stack else body
    body += "".join(reversed(stack))
    body = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', body)
    body = re.sub(r",\s*([}\]])", r"\1", body)
    try:
        return json.dumps(json.loads(body), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def repaired(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(repair_json)

    return run(text)
