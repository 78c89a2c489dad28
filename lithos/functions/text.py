"""Text scalars: Column -> Column, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"


def normalize_text(text: Column) -> Column:
    """Tags out, ideographic space and runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"(?U)\s+", " "))


def match_form(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def _bigrams(chars: Column) -> Column:
    return F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))).otherwise(F.array().cast("array<string>"))


def bm25_tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and _, then bigrams of the CJK characters, whatever lies between them."""
    low = F.lower(text)
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0), _bigrams(F.regexp_extract_all(low, F.lit(CJK), 0)))


def similarity_tokens(text: Column) -> Column:
    """Set of ASCII runs of two or more and CJK bigrams, after white space is removed."""
    low = F.lower(match_form(text))
    return F.array_distinct(F.concat(_bigrams(F.regexp_extract_all(low, F.lit(CJK), 0)), F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), 0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def distinct_terms(terms: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(terms, lambda x: F.trim(x)), lambda x: x != ""))


def truncate_text(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def strip_markers(text: Column) -> Column:
    """Without the marks of the evidence renderer: [CHAIN_LEN=...], [CAUSAL_ORDER=...], [EVIDENCE_TYPES=...] and [E1], each with the space after it."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\[(?:(?:CHAIN_LEN|CAUSAL_ORDER|EVIDENCE_TYPES)=[^\]]+|E\d+)\]\s*", ""), r"(?U)\A\s+|\s+\z", "")


def sentences(text: Column, ends: str = r"[\n\r。！？；]+") -> Column:
    return F.filter(F.transform(F.split(text, ends), lambda x: F.trim(x)), lambda x: x != "")


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    return sum((F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in terms), F.lit(0))


def html_lines(page: Column, least: int = 8) -> Column:
    """Lines of at least `least` characters of a page's text; a small set of character references is decoded."""
    x = F.regexp_replace(page, r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f]+", " "))), lambda s: F.length(s) >= least)
