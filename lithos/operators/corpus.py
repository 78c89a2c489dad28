"""Building the passage table: segments, chunks, lookups, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_segments(turns: DataFrame, story: str, place: str, speaker: str, text: str) -> DataFrame:
    """Neighbouring turns of one speaker become one segment, joined by a line feed (gaps and islands)."""
    w = Window.partitionBy(story).orderBy(place)
    breaks = turns.withColumn("_new", F.coalesce((F.col(speaker) != F.lag(speaker).over(w)).cast("int"), F.lit(1)))
    islands = breaks.withColumn("segment", F.sum("_new").over(w) - 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, text))), lambda x: x[text]), "\n")
    return islands.groupBy(story, "segment", speaker).agg(joined.alias("text"))


def pack_chunks(lengths: Column, max_chars: int = 420, overlap: int = 1) -> Column:
    """Greedy packing of segment lengths, as the chunks' (first, last) segments.

    Every segment takes its length and a separator. A chunk is closed when the
    next one's would not fit; the next chunk starts with its last `overlap`
    segments, whose separators don't count. A segment is never split, so a
    chunk can exceed max_chars.
    """
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(empty.alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(s: Column, length: Column) -> Column:
        full = (s.n > 0) & (s["size"] + length + 1 > max_chars) & (s.n - s["first"] > 0)
        carry = F.greatest(s["first"], s.n - overlap)
        kept = F.aggregate(F.slice(lengths, carry + 1, s.n - carry), F.lit(0), lambda a, x: a + x)
        last = F.struct(s["first"].alias("first"), (s.n - 1).alias("last"))
        return F.struct(
            F.when(full, F.concat(s.done, F.array(last))).otherwise(s.done).alias("done"),
            F.when(full, carry).otherwise(s["first"]).cast("int").alias("first"),
            (s.n + 1).cast("int").alias("n"),
            (F.when(full, kept).otherwise(s["size"]) + length + 1).cast("int").alias("size"),
        )

    def finish(s: Column) -> Column:
        return F.when(s.n > 0, F.concat(s.done, F.array(F.struct(s["first"].alias("first"), (s.n - 1).cast("int").alias("last"))))).otherwise(s.done)

    return F.aggregate(lengths, start, step, finish)


def resolve(fact: DataFrame, lookups: list[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """A chain of left lookups: each (table, key in the rows so far, key of the table, new column -> its column). Blank strings are missing."""
    for dim, own, key, columns in lookups:
        picked = dim.select(F.col(key).alias("_key"), *[F.nullif(F.trim(c), F.lit("")).alias(n) if dict(dim.dtypes)[c] == "string" else F.col(c).alias(n) for n, c in columns.items()])
        fact = fact.join(picked, fact[own] == picked._key, "left").drop("_key")
    return fact


def alias_closure(groups: DataFrame, group: str, name: str) -> DataFrame:
    """(name, related): all other names of the groups that a name is in, sorted."""
    x, y = groups.select(F.col(group).alias("g"), F.col(name).alias("name")), groups.select(F.col(group).alias("g"), F.col(name).alias("other"))
    return x.join(y, "g").where("name != other").groupBy("name").agg(F.sort_array(F.collect_set("other")).alias("related"))


def append_aliases(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Related terms, absent from the text, of the aliases in it, in order of alias."""
    found = F.array().cast("array<string>")
    for alias, related in sorted(aliases.items()):
        new = F.filter(F.array(*[F.lit(r) for r in related]), lambda r: ~text.contains(r))
        found = F.concat(found, F.when(text.contains(alias), new).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(found)
