"""Lookup tables of the corpus, and the description of a story by a chain of left lookups.

Each table is a DataFrame of (key, ...); names are normalised and blank ones
left out. Where several rows give one key, the one with the last `place` counts, unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.stories import activity_hint, stage_id, stage_of_key, story_key
from lithos.functions.text import normalize_text


def _blank(text: Column) -> Column:
    return F.nullif(normalize_text(text.cast("string")), F.lit(""))


def _one(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def names(table: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of the entries with a name."""
    return table.select(F.col(key).cast("string").alias("key"), _blank(F.col(name)).alias("name")).where("name is not null")


def speakers(characters: DataFrame, npcs: DataFrame, variables: DataFrame) -> DataFrame:
    """(key, name): names of characters and, before them, of other persons; and for each variable (key, target) that stands for one of them its key and $key."""
    both = npcs.select("key", "name", F.lit(1).alias("p")).union(characters.select("key", "name", F.lit(2).alias("p")))
    known = _one(both, "key", F.asc("p")).drop("p")
    v = variables.select(_blank(F.col("key")).alias("own"), _blank(F.col("target")).alias("target")).where("own is not null and target is not null")
    stands = v.join(known.withColumnRenamed("key", "target"), "target").select("own", "name")
    stands = stands.union(stands.select(F.concat(F.lit("$"), "own"), "name")).toDF("key", "name")
    return stands.union(known.join(stands.select("key"), "key", "left_anti")).distinct()


def chapters(zones: DataFrame, chapter_table: DataFrame) -> DataFrame:
    """(key, chapter_id, chapter_name) by zone. zones: (key, chapter_id); chapter_table: (key, chapter_id, name)."""
    named = chapter_table.select(F.col("key").alias("_key"), F.col("chapter_id").alias("_id"), _blank(F.col("name")).alias("chapter_name")).where("chapter_name is not null")
    return zones.join(named, zones.chapter_id == named._key).select("key", F.col("_id").alias("chapter_id"), "chapter_name")


def topics(table: DataFrame) -> DataFrame:
    """(key, name) of topics (key, id, name), in lower case; rogue_<x> is known as ro<x> too."""
    t = table.select(F.lower(normalize_text(F.coalesce(F.col("id"), F.col("key")))).alias("key"), _blank(F.col("name")).alias("name")).where("name is not null and key != ''")
    return t.union(t.where("key like 'rogue\\\\_%'").select(F.replace("key", F.lit("rogue_"), F.lit("ro")), "name")).distinct()


def reviews(groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By story, by stage, and names of activities.

    groups: (place, key, name, items: array of (story_txt, story_group,
    story_code, story_name, avg_tag, story_sort, stages: array of stage ids)).
    Of a story the last entry counts, of a stage the first.
    """
    name = _blank(F.col("name"))
    items = groups.select("place", "key", name.alias("group_name"), F.posexplode("items").alias("n", "i")).where("coalesce(i.story_txt, '') != ''")
    entry = items.select(
        story_key(F.col("i.story_txt")).alias("story_key"), "place", "n", F.coalesce(F.nullif("i.story_group", F.lit("")), "key").alias("story_group"), F.col("group_name").alias("story_group_name"),
        *[F.col(f"i.{c}").alias(c) for c in ("story_code", "story_name", "avg_tag", "story_sort")], stage_id(F.try_element_at("i.stages", F.lit(1))).alias("stage_id"),
    )
    by_story = _one(entry, "story_key", F.desc("place"), F.desc("n")).drop("place", "n")
    by_stage = _one(entry.where("stage_id is not null"), "stage_id", F.asc("place"), F.asc("n")).drop("place", "n", "story_key")
    return by_story, by_stage, groups.select(F.lower("key").alias("key"), name.alias("name")).where("name is not null")


REVIEW = ["story_group", "story_group_name", "story_code", "story_name", "avg_tag", "story_sort"]


def describe(stories: DataFrame, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """`stories` with what the tables know of each, the first source that has a value deciding.

    tables: `review` and `review_stage` (of `reviews`), `story` (key, id,
    trigger_key, trigger_type, required), `stage` (key, zone_id, code, name,
    stage_type), `zone` (key, zone_name), `chapter` (of `chapters`),
    `zone_activity` (key, activity), `activity`, `review_activity` and `topic`
    (key, name). Lookup tables are small next to the corpus; Spark decides
    which of them to broadcast by their size.
    """

    def left(rows: DataFrame, table: DataFrame, own: str, key: str, prefix: str) -> DataFrame:
        t = table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])
        return rows.join(t, F.col(own) == F.col(f"{prefix}{key}"), "left")

    t = tables
    x = stories.withColumn("story_key", story_key(F.col(path)))
    x = left(left(x, t["review"], "story_key", "story_key", "r_"), t["story"], "story_key", "key", "s_")
    own = [F.col("r_stage_id"), F.col("s_trigger_key"), F.col("s_required"), stage_of_key(F.col("story_key"))]
    x = x.withColumn("stage_id", stage_id(F.coalesce(*[F.nullif(c, F.lit("")) for c in own])))
    x = left(left(x, t["review_stage"], "stage_id", "stage_id", "g_"), t["stage"], "stage_id", "key", "t_")
    known = F.col("r_story_key").isNotNull()
    x = x.select("*", *[F.when(known, F.col(f"r_{c}")).otherwise(F.col(f"g_{c}")).alias(f"m_{c}") for c in REVIEW])
    x = x.withColumn("zone_id", F.col("t_zone_id"))
    x = left(left(left(x, t["zone"], "zone_id", "key", "z_"), t["chapter"], "zone_id", "key", "c_"), t["zone_activity"], "zone_id", "key", "y_")
    some = lambda *c: F.coalesce(*[F.nullif(k, F.lit("")) for k in c])
    x = x.withColumn("activity_id", some(F.col("m_story_group"), F.col("y_activity"), activity_hint(F.col("story_key")))).withColumn("_low", F.lower("activity_id"))
    x = left(left(left(x, t["activity"], "activity_id", "key", "a_"), t["review_activity"], "_low", "key", "v_"), t["topic"], "_low", "key", "o_")
    return x.select(
        *stories.columns, "story_key", F.coalesce(F.nullif("s_id", F.lit("")), F.replace(path, F.lit("/"), F.lit("_"))).alias("story_id"), "activity_id",
        some(F.col("m_story_group_name"), normalize_text(F.col("a_name")), F.col("v_name"), F.col("o_name")).alias("activity_name"),
        some(F.col("m_story_name"), F.col("t_name")).alias("story_name"), some(F.col("m_story_code"), F.col("t_code")).alias("story_code"),
        F.col("m_avg_tag").alias("avg_tag"), F.col("m_story_sort").alias("story_sort"), "stage_id", F.col("t_code").alias("stage_code"), F.col("t_name").alias("stage_name"),
        F.col("t_stage_type").alias("stage_type"), "zone_id", F.col("z_zone_name").alias("zone_name"), F.col("c_chapter_name").alias("chapter_name"), F.col("s_trigger_type").alias("trigger_type"),
    )


def corpus_union(parts: list[DataFrame]) -> DataFrame:
    """Stories, profiles and voices as one table; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
