"""Scalars over story keys, chapters, scripts and dialogue: Column -> Column, built-in functions only. A null gives a null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.functions.text import distinct_terms, normalize_text, strip_markers

SPACE = r"(?U)\s+"
EDGES = r"(?U)\A\s+|\s+\z"

# Numerals, how a chapter is named, what is cut from an anchor, names without a story of their own.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHAPTER_REF = r"(?iU)第\s*[一二三四五六七八九十百零〇两0-9]{1,4}\s*章|[0-9]{1,2}\s*章|level_main[_-][0-9]{1,2}|main[_-][0-9]{1,2}"
CHAPTER_NAMES = ["第{0}章", "{0}章", "main_{1}", "level_main_{1}", "main_{0}", "level_main_{0}", "EPISODE {0}"]
ANCHOR_NOISE = "这种题|这类题|这个问题|这种问题|题目|问题|反而|检索|证据|不足|为什么|为何|怎么|如何|吗|呢|啊|吧"
ANCHOR_MARKS = r"“”\"'「」『』《》：:，,。！？?；;、（）()\[\]【】"
QUESTION_WORDS = ["什么", "怎么", "为何", "为什么", "如何"]
PARTICLES = ["的", "了", "吗", "呢", "吧", "啊", "着", "过"]
UNNAMED_STORIES = ["晋升记录", "模组故事", "语音记录"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def story_key(path: Column) -> Column:
    """A story's file name as a key: forward slashes, no .txt, no leading ./ or [uc]info/, lower case."""
    x = strip(F.replace(path, F.lit("\\"), F.lit("/")))
    x = F.regexp_replace(x, r"\.txt\z", "")
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\A\./", ""), r"(?i)\A\[uc\]info/", ""))


def stage_id(raw: Column) -> Column:
    """Normalised, in lower case; null if nothing is left."""
    return _or_null(F.lower(normalize_text(raw)))


def _parts(key: Column) -> Column:
    return F.filter(F.split(key, "/"), lambda p: (p != "") & (p != "."))


def stage_of_key(key: Column) -> Column:
    """The stage that a file name level_<stage>[_beg|_end] speaks of, else null."""
    name = F.lower(F.try_element_at(_parts(key), F.lit(-1)))
    return _or_null(F.when(name.startswith("level_"), F.regexp_replace(F.substring(name, 7, 1 << 30), "_(beg|end)$", "")))


def activity_hint(key: Column) -> Column:
    """The activity that a path names: below activities/ or obt/roguelike/, else its first folder."""
    p = _parts(key)
    part = lambda i: F.lower(F.try_element_at(p, F.lit(i)))
    first, second = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))
    return F.when((F.size(p) > 1) & (first == "activities"), part(2)).when((F.size(p) > 2) & (first == "obt") & (second == "roguelike"), part(3)).when(F.size(p) > 1, part(1))


def zone_name(*names: Column) -> Column:
    """The distinct names that are not empty, with a space between; null if there is none."""
    return _or_null(F.array_join(distinct_terms(F.array(*[normalize_text(F.coalesce(n, F.lit(""))) for n in names])), " "))


def chapter_number(raw: Column) -> Column:
    """1 to 99 of Arabic or Chinese numerals (0 of a lone zero sign), else null."""
    x = strip(raw)
    digit = F.create_map(*[F.lit(v) for pair in NUMERALS.items() for v in pair])
    of = lambda c, missing: F.coalesce(F.try_element_at(digit, c), F.lit(missing))
    left, right = F.substring_index(x, "十", 1), F.expr("1")
    right = F.substring(x, F.length(left) + 2, 1 << 30)
    tens = F.when(left != "", of(left, 1)).otherwise(1) * 10 + F.when(right != "", of(right, 0)).otherwise(0)
    arabic = F.when(x.rlike(r"\A[0-9]{1,9}\z"), x.try_cast("int"))
    value = F.when(arabic.isNotNull(), arabic).when(x.contains("十"), tens)
    return F.when((value > 0) & (value < 100), value).when(value.isNull() & (F.length(x) == 1), F.try_element_at(digit, x))


def chapter_numbers(text: Column) -> Column:
    """Numbers of the chapters that a text speaks of, each once, in order; of a null text none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHAPTER_REF), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(found, lambda m: chapter_number(F.regexp_extract(m, "[一二三四五六七八九十百零〇两0-9]+", 0)))))


def chapter_terms(text: Column) -> Column:
    """The ways in which the chapters of a text are written elsewhere, to search for."""
    def names(n: Column) -> Column:
        plain, padded = n.cast("string"), F.lpad(n.cast("string"), 2, "0")
        return F.array(*[F.replace(F.replace(F.lit(c), F.lit("{0}"), plain), F.lit("{1}"), padded) for c in CHAPTER_NAMES])

    return F.array_distinct(F.flatten(F.transform(chapter_numbers(text), names)))


def script_context(text: Column) -> Column:
    """Lines of a raw script as prose: sticker texts, speakers before a colon, commands out; of a null text null."""
    def cleaned(line: Column) -> Column:
        stickers = F.regexp_extract_all(line, F.lit(r'text="((?:\\.|[^"\\])*)"'), F.lit(1))
        said = F.transform(stickers, lambda s: strip(F.replace(F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\t"), F.lit(" "))))
        plain = strip(F.regexp_replace(F.regexp_replace(line, r'^\[name="([^"]+)"\](.*)$', "$1：$2"), r"\[[^\]]+\]", ""))
        return F.filter(F.when(F.size(stickers) > 0, said).otherwise(F.array(plain)), lambda x: x != "")

    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda x: x != "")
    return strip(strip_markers(F.array_join(F.flatten(F.transform(lines, cleaned)), "\n")))


def line_context(lines: Column, at: Column, window: int = 2) -> Column:
    """The lines within `window` of line `at` (from 0), without blank ones."""
    first = F.greatest(at - window, F.lit(0))
    near = F.slice(lines, first + 1, F.greatest(at + window + 1 - first, F.lit(0)))
    return F.array_join(F.filter(F.transform(near, strip), lambda x: x != ""), "\n")


def dialogue_entries(text: Column) -> Column:
    """(role, content) of the lines of a dialogue; role: user, assistant or null; entries without content are left out."""
    def entry(line: Column) -> Column:
        role = _or_null(F.lower(F.regexp_extract(line, r"(?iU)\A(user|assistant)\s*:\s*(.*)\z", 1)))
        return F.struct(role.alias("role"), F.when(role.isNotNull(), strip(F.regexp_extract(line, r"(?iU)\A(user|assistant)\s*:\s*(.*)\z", 2))).otherwise(line).alias("content"))

    return F.filter(F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), strip), entry), lambda e: e.content != "")


def resolve_pronoun(question: Column, entities: Column, pronouns: list[str]) -> Column:
    """The first occurrence of the longest pronoun that a question has, replaced by its first one or two entities."""
    x = strip(question)
    anchor = F.array_join(F.slice(entities, 1, 2), "和")
    out = x
    for p in sorted(pronouns, key=len):  # the longest is tested first, so it comes last
        at = F.instr(x, p)
        out = F.when(at > 0, F.concat(F.substring(x, 1, at - 1), anchor, F.substring(x, at + len(p), 1 << 30))).otherwise(out)
    return F.when((x == "") | (F.size(entities) < 1), x).otherwise(out)


def anchor_term(term: Column) -> Column:
    """A term without white space and marks around, cut where question words begin; a null is empty."""
    bare = lambda x: F.regexp_replace(x, rf"\A[{ANCHOR_MARKS}]+|[{ANCHOR_MARKS}]+\z", "")
    x = bare(F.regexp_replace(F.coalesce(term, F.lit("")), SPACE, ""))
    return bare(F.element_at(F.split(x, ANCHOR_NOISE, 2), 1))


def generic_entity(token: Column, stop: list[str]) -> Column:
    """Whether a token may name something: 2 to 16 characters, no stop word, no question word in it, no particle at its end."""
    x = strip(token)
    asks = reduce(Column.__or__, [x.contains(w) for w in QUESTION_WORDS])
    ends = reduce(Column.__or__, [x.endswith(p) for p in PARTICLES])
    return F.length(x).between(2, 16) & ~x.isin(stop or [""]) & ~asks & ~ends


def story_name(activity: Column, story: Column, excluded: list[str]) -> Column:
    """The first of activity and story that names a story; empty if none does."""
    def usable(name: Column) -> Column:
        x = strip(F.regexp_replace(F.coalesce(name, F.lit("")), SPACE, " "))
        return F.when((x != "") & ~x.isin([*excluded, *UNNAMED_STORIES]) & ~x.startswith("档案资料"), x)

    return F.coalesce(usable(activity), usable(story), F.lit(""))
