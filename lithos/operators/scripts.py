"""Story scripts: lines to segments by windows, segments to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions.stories import strip
from lithos.functions.text import normalize_text
from lithos.operators.corpus import pack_chunks

# Forms of a script's lines.
HEADER = r"\A\[HEADER.*\]\s*(.+)\z"
SPOKEN = r'\A\[name="([^"]+)"\]\s*(.*)\z'
HEAD = r'(?i)dialogHead="([^"]+)"'


def head_speaker(line: Column, lookup: dict[str, str]) -> Column:
    """Whom a command's dialogHead stands for: looked up as it is, or without its $; else the head itself. Null without one."""
    head = F.nullif(normalize_text(F.regexp_extract(line, HEAD, 1)), F.lit(""))
    if not lookup:
        return head
    known = F.create_map(*[F.lit(v) for pair in lookup.items() for v in pair])
    return F.coalesce(F.try_element_at(known, head), F.try_element_at(known, F.regexp_replace(head, r"\A\$+", "")), head)


def trailing_text(line: Column) -> Column:
    """What follows a line's last bracket, without a leading backslash."""
    rest = F.when(line.contains("]"), strip(F.element_at(F.split(line, r"\]", -1), -1))).otherwise("")
    return normalize_text(F.when(rest.startswith("\\"), F.substring(rest, 2, 1 << 30)).otherwise(rest))


def render(speaker: Column, text: Column) -> Column:
    return F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit("："), text)).otherwise(text)


def parse(lines: DataFrame, story: str, place: str, line: str, lookup: dict[str, str] | None = None) -> DataFrame:
    """(story, segment, speaker, text, kind) of the lines of each story.

    kind: header, dialogue or narration. Plain lines up to the next line of
    another form are one text; its speaker is the one that the last command
    named, if nothing has been said since. Neighbouring segments of one
    speaker and kind become one, with a line feed between. A story is one
    window; empty lines end a text and say nothing. Lines that are null count as empty.
    """
    x = strip(F.coalesce(F.col(line), F.lit("")))
    rows = lines.select(F.col(story).alias("story"), F.col(place).alias("place"), x.alias("x"))
    x = F.col("x")
    form = F.when(x == "", "blank").when(x.rlike(HEADER), "header").when(x.rlike(SPOKEN), "spoken").when(x.startswith("["), "command").otherwise("plain")
    rows = rows.withColumn("form", form)
    after = F.when(F.col("form") == "command", trailing_text(F.col("x")))
    rows = rows.withColumn("after", after).withColumn("head", F.when(F.col("form") == "command", head_speaker(F.col("x"), lookup or {})))
    order = Window.partitionBy("story").orderBy("place")
    # a command without a text leaves its speaker waiting; a plain line takes them
    waits = F.when(F.col("form").isin("command", "plain"), F.struct(F.when(F.col("after") == "", F.col("head")).alias("who")))
    rows = rows.withColumn("waits", F.last(waits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    starts = (F.col("form") != "plain") | F.coalesce(F.lag("form").over(order) != "plain", F.lit(True))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(order)).where("form != 'blank'")
    first = F.min_by(F.struct("form", "x", "after", "head", F.col("waits.who").alias("who")), "place").alias("f")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda r: r.x), " ").alias("plain")  # a block's own lines
    blocks = rows.groupBy("story", "block").agg(first, joined)
    form, spoken = F.col("f.form"), lambda i: normalize_text(F.regexp_extract("f.x", SPOKEN, i))
    text = F.when(form == "header", normalize_text(F.regexp_extract("f.x", HEADER, 1))).when(form == "spoken", spoken(2)).when(form == "command", F.col("f.after")).otherwise(normalize_text(F.col("plain")))
    speaker = F.when(form == "spoken", spoken(1)).when(form == "command", F.col("f.head")).when(form == "plain", F.col("f.who"))
    kind = F.when(form == "header", "header").when((form == "spoken") | (F.coalesce(speaker, F.lit("")) != ""), "dialogue").otherwise("narration")
    said = blocks.select("story", "block", speaker.alias("speaker"), text.alias("text"), kind.alias("kind")).where("text != ''")
    by_block = Window.partitionBy("story").orderBy("block")
    same = F.col("speaker").eqNullSafe(F.lag("speaker").over(by_block)) & (F.col("kind") == F.lag("kind").over(by_block))
    said = said.withColumn("segment", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(by_block) - 1)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda r: r.text), "\n")
    return said.groupBy("story", "segment", "speaker", "kind").agg(whole.alias("text")).select("story", "segment", "speaker", "text", "kind")


def chunks(segments: DataFrame, max_chars: int = 420, overlap: int = 1) -> DataFrame:
    """(story, chunk, first, last, text) of parsed segments: rendered, packed up to `max_chars`, one line for each segment."""
    item = F.struct("segment", render(F.col("speaker"), F.col("text")).alias("said"))
    stories = segments.groupBy("story").agg(F.sort_array(F.collect_list(item)).alias("items"))  # one story's
    packed = stories.select("story", "items", F.posexplode(pack_chunks(F.transform("items", lambda i: F.length(i.said)), max_chars, overlap)).alias("chunk", "c"))
    text = F.array_join(F.transform(F.slice("items", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), lambda i: i.said), "\n")
    return packed.select("story", "chunk", F.col("c.first").alias("first"), F.col("c.last").alias("last"), text.alias("text"))
