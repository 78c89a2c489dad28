"""What a model returns: its output cleaned, abstaining answers found, string lists and evidence cut to size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What runners print around an answer, in the order in which it goes; separators of a list in one string.
NOISE = [
    r"(?md)^\[\s*Prompt:.*\]$",
    r"(?sU)<think>.*?</think>\s*",
    r"(?md)^warning:.*$",
    r"(?md)^(main|common_|llama_|load_|print_info:|system_info:|sampler ).*$",
    r"\[end of text\]",
]
SEPARATORS = r"(?U)[、,，;；]\s*"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clean_output(text: Column, prompt: Column) -> Column:
    """Without an echo of the prompt at the start, thoughts and log lines. A null text stays null; a null prompt is no prompt."""
    out, echo = strip(text), F.coalesce(prompt, F.lit(""))
    out = F.when(out.startswith(echo), out.substr(F.length(echo) + 1, F.length(out))).otherwise(out)
    return reduce(lambda x, noise: strip(F.regexp_replace(x, noise, "")), NOISE, strip(out))


def string_list(text: Column, limit: int) -> Column:
    """Parts of one string, trimmed, each once, in order, `limit` at most (a limit of the payload's schema); of a null or blank one, none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), strip)
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, limit)


def abstain_markers(answer: Column, markers: list[str]) -> Column:
    """The markers that an answer holds, in their order."""
    return F.array_compact(F.array(*[F.when(answer.contains(m), F.lit(m)) for m in markers]).cast("array<string>"))


def abstains(action: Column, answer: Column, markers: list[str]) -> Column:
    """Whether the action or the answer's words decline; null of both is no."""
    return F.coalesce(action == "abstain", F.lit(False)) | (F.size(abstain_markers(answer, markers)) > 0)


def brief(text: Column, limit: int) -> Column:
    """White space to one space; cut to `limit` characters, the last of them an ellipsis. A null text is empty."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(strip(flat.substr(1, limit - 1)), F.lit("…"))).otherwise(flat)


def abstain_evidence(evidence: DataFrame, group: str, order: list[Column], text: str, keep: int = 3, limit: int = 900) -> DataFrame:
    """The first `keep` rows of each group with their rank from 1 and `text` in brief: what is attached to an answer that abstains. Ranked before any text is cut, with a limit that goes before the shuffle."""
    ranked = evidence.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= keep).withColumn(text, brief(F.col(text), limit))
