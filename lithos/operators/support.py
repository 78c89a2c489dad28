"""What a text's words add to its score: causality, concept and crisis, definitions. Lexicons are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.functions.text import hits

# How near a marker defines an anchor, how many anchors are looked at, and the least score of a definition.
REACH, NEAR_ANCHORS, LEAST_DEFINITION = 32, 4, 7


def _most(count: Column, limit: int, weight: float) -> Column:
    return F.least(count, F.lit(limit)) * weight


def causality(text: Column, exact: list[str], actions: list[str], markers: list[str], direct: list[str], narrative: Column, profile: Column) -> Column:
    """Bonus for a question about causes. exact: its terms of four characters or more; direct: the markers that count for a profile. A null text has none of the words."""
    m, x, a = hits(text, markers), hits(text, exact), hits(text, actions)
    score = F.when((m > 0) & (x + a > 0), _most(m, 4, 0.42) + _most(x, 2, 0.28) + _most(a, 2, 0.35)).when((x > 0) & (a > 0), 0.35).otherwise(0.0)
    score = score + F.when((m >= 2) & narrative, 0.55).otherwise(0.0)
    return F.when(profile & ((hits(text, direct) == 0) | (a == 0)), F.least(score, F.lit(0.2)) - 1.2).otherwise(score)


def concept_crisis(text: Column, subjects: list[str], definitions: list[str], crises: list[str], imagined: Column, generic: list[str]) -> Column:
    """Bonus for a question on what a thing is and why it is a danger; -1.8 without the thing, 0 for an empty or null text. imagined: dreams of side stories."""
    s, d, c = hits(text, subjects), hits(text, definitions), hits(text, crises)
    score = _most(s, 2, 0.8) + _most(d, 4, 0.28) + _most(c, 5, 0.34)
    score = score + F.when((d >= 1) & (c >= 1), 1.0).otherwise(0.0) + F.when((d >= 2) & (c >= 2), 0.9).otherwise(0.0)
    score = score - F.when(imagined, 0.65).otherwise(0.0) - F.when((c == 0) & (hits(text, generic) > 0), 1.0).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(s == 0, -1.8).otherwise(score)


def definition(text: Column, anchors: list[str], markers: list[str]) -> Column:
    """4 for each anchor, 1 for each of four markers, 3 for each of the first four anchors found that stands within REACH characters of a marker. White space aside; 0 without an anchor."""
    compact = F.regexp_replace(text, r"\s+", "")
    found, near = F.lit(0), F.lit(0)
    words = "|".join(re.escape(m) for m in markers)
    for anchor in filter(None, (re.sub(r"\s+", "", anchor) for anchor in anchors)):
        has = F.coalesce(compact.contains(anchor), F.lit(False))
        a = re.escape(anchor)
        beside = compact.rlike(rf"{a}.{{0,{REACH}}}(?:{words})|(?:{words}).{{0,{REACH}}}{a}") if markers else F.lit(False)
        near = near + F.when(has & (found < NEAR_ANCHORS) & beside, 3).otherwise(0)
        found = found + has.cast("int")
    return F.when(found == 0, 0).otherwise(found * 4 + F.least(hits(compact, markers), F.lit(4)) + near)
