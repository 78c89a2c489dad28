"""The driver's queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import decontaminate, language, lines, minhash, neighbours, packing, pages, sharding, suffixes, urls
from lithos.llm.common import table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHARDS = 40


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out("doc_id")), "doc_id", "text", "lang")
    out = language.identify(docs, "text", model, ["doc_id"])
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_mix")


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and bad: whether the document that the url's path ends in is labelled toxic or of low quality (null: no label)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(\.html)?/?$", 1)
    pages = pages.withColumn("_doc", number.try_cast("long"))
    return pages.join(labels, pages._doc == labels.doc_id, "left").select("page_id", "url", "bad")


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urls.judge(labelled_pages(spark, sf_dir), "url", "bad", ["page_id"], URL_RULES).drop("bound")


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of every document, in 40 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = sharding.shard(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op7_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its near-duplicates), copy_of (of the texts with the same words) of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_removed of every document."""
    return lines.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def op10_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the ten nearest of every hundredth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id % 100 = 0")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {q.__name__: q for q in (op1_language, op2_bagminhash, op3_projection_forest, op4_url_reputation, op5_main_text, op6_feistel_shards, op7_window_packing, op8_repeated_spans, op9_fuzzy_lines, op10_cgk_leaks)}
ORACLES: dict[str, str] = {}
