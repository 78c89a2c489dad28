"""Operator 5: main text of web pages, with a suffix array of each host.

A page is read as blocks of text. Blocks inside scripts, styles, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are
furniture by their markup; blocks inside an article or main element are
content by it. What markup leaves open is decided by the host: the token
streams of its open blocks are one text, whose suffixes are sorted by their
first RUN tokens; where two distinct pages have neighbours with equal prefixes,
these RUN tokens are boilerplate. A block covered by such runs for the most part goes,
other runs stay.

Content by markup is not held against the host, since articles that a site prints
twice, or passages that its articles share, repeat just as furniture does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import U64, mix, seeded, strings
from lithos.llm.urls import host_of

#: Tokens of a long substring, and the share of a block's tokens that must be covered for it to go.
RUN, COVERED = 4, 0.8

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z|[^<]+|<""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = frozenset("script style noscript template iframe object svg textarea title".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("head nav header footer aside form menu dialog button select fieldset label".split())
_CONTENT = frozenset("article main".split())
_ROLE_FURNITURE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Whole names of class or id by which sites mark such containers; a name that merely holds one of these words says nothing.
_NAME_FURNITURE = frozenset(
    "ad ads advert advertisement sponsored banner nav navbar menu breadcrumb breadcrumbs header footer sidebar widget cookie-banner cookie-notice cookies consent notice newsletter subscribe comment comments comment-list disqus respond replies popup modal".split()
)
_NAME_CONTENT = frozenset("article content post entry story main articlebody".split())
#: Elements whose names count.
_CONTAINERS = frozenset("div section ul ol dl table figure details".split())
#: Paragraphs end where another one begins, list items likewise.
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

FURNITURE, OPEN, CONTENT = 0, 1, 2


def _kind(tag: str, attributes: str, above: int) -> int:
    """Of an element in one of kind `above`."""
    if above == FURNITURE:
        return FURNITURE
    if tag in _FURNITURE and not (tag == "header" and above == CONTENT):
        return FURNITURE
    named_content = False
    if attributes and tag not in ("body", "html"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "").lower()
            if name.lower() == "role":
                if value in _ROLE_FURNITURE:
                    return FURNITURE
                named_content |= value in ("main", "article")
            else:
                names = set(value.split()) if tag in _CONTAINERS else set()
                if names & _NAME_FURNITURE:
                    return FURNITURE
                named_content |= bool(names & _NAME_CONTENT)
    return CONTENT if above == CONTENT or tag in _CONTENT or named_content else OPEN


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page that are not furniture, in order; white space is one space, references are decoded."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, parts = OPEN, []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((kind, text))
            parts.clear()

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        close, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)  # the second: a quote that is never closed
        if tag is None:
            token = m.group()
            if kind != FURNITURE and (token[0] != "<" or token == "<"):
                parts.append(token)
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not close and not attributes.endswith("/"):  # what is inside is no markup
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ") if tag == "br" and kind != FURNITURE else None
            continue
        if tag in _BLOCK:
            flush()
        if close:
            level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if level is not None:
                if tag not in _BLOCK and any(t in _BLOCK for t, _ in stack[level + 1 :]):
                    continue  # an inline end tag does not close blocks
                if kind != (stack[level - 1][1] if level else OPEN):
                    flush()
                del stack[level:]
                kind = stack[-1][1] if stack else OPEN
            continue
        ends = _CLOSES.get(tag)
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    kind = stack[-1][1] if stack else OPEN
                    break
                if stack[i][0] in _BLOCK and stack[i][0] not in ("tbody", "thead", "tfoot"):
                    break
        new = _kind(tag, attributes, kind)
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        if new != kind:
            flush()
        stack.append((tag, new))
        kind = new
    flush()
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [blocks(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("page_id", "url", "host")], pa.array([[{"open": k == OPEN, "text": t} for k, t in f] for f in found], pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())])))],
            ["page_id", "url", "host", "blocks"],
        )


def runs_of(open_blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first RUN tokens of every suffix of the open blocks' token stream, and the tokens of each block; shorter suffixes end in a mark."""
    tokens = [t for text in open_blocks for t in text.split()]
    sizes = np.array([len(text.split()) for text in open_blocks])
    h = np.array([xxhash.xxh64_intdigest(t) for t in tokens] + [0] * (RUN - 1), U64)
    out = np.zeros(len(tokens), U64)
    for j, salt in enumerate(seeded(RUN, 61)):
        out = mix(out ^ h[j : j + len(tokens)] * (salt | U64(1)))
    return out, sizes


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, prefix, page: once for each suffix prefix of a page with open blocks. page: a hash of all its text, so that copies of a page are one."""
    for b in batches:
        host, prefix, page = [], [], []
        for h, found in zip(b.column("host").to_pylist(), b.column("blocks").to_pylist(), strict=True):
            texts = [x["text"] for x in found if x["open"]]
            if texts:
                p = np.unique(runs_of(texts)[0])
                host += [h] * len(p)
                prefix.append(p)
                page.append(np.full(len(p), xxhash.xxh64_intdigest("\n".join(x["text"] for x in found)), U64))
        if host:
            yield pa.RecordBatch.from_arrays([strings(host), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (prefix, page)]], ["host", "prefix", "page"])


def _kept(found: list[dict], repeated: set[int]) -> str:
    texts = [x["text"] for x in found if x["open"]]
    gone: list[bool] = []
    if texts and repeated:
        prefix, sizes = runs_of(texts)
        hit = np.fromiter((int(p) in repeated for p in prefix.astype(np.int64)), bool, len(prefix))
        covered = hit.copy()
        for j in range(1, RUN):
            covered[j:] |= hit[: len(hit) - j]
        ends = np.cumsum(sizes)
        gone = [c >= COVERED * n for c, n in zip(np.add.reduceat(covered, ends - sizes), sizes, strict=True)]
    flags = iter(gone or [False] * len(texts))
    return "\n".join(x["text"] for x in found if not (x["open"] and next(flags)))


def main_text(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; text is empty if there is none.

    A null or empty page has no text; a null url is of the empty host. A run
    counts as repeated if two pages of the host with different text have it,
    so exact copies of a page don't make it boilerplate. Hosts are never
    gathered in one task: suffixes are dealt by host and prefix, with a
    map-side minimum and maximum, and sorting groups them; answers go back by page.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    read = rows.mapInArrow(_read, f"page_id {pages.schema[key].dataType.simpleString()}, url string, host string, blocks array<struct<open:boolean,text:string>>")
    suffixes = read.mapInArrow(_suffixes, "host string, prefix long, page long")
    repeated = suffixes.groupBy("host", "prefix").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo < hi").select("host", "prefix")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, host, prefix = [], [], []
            for i, (h, found) in enumerate(zip(b.column("host").to_pylist(), b.column("blocks").to_pylist(), strict=True)):
                texts = [x["text"] for x in found if x["open"]]
                if texts:
                    p = np.unique(runs_of(texts)[0])
                    pid += [i] * len(p)
                    host += [h] * len(p)
                    prefix.append(p)
            if host:
                yield pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(pid)), b.column("url").take(pa.array(pid)), strings(host), pa.array(np.concatenate(prefix).astype(np.int64))], ["page_id", "url", "host", "prefix"])

    kind = pages.schema[key].dataType.simpleString()
    asked = read.mapInArrow(own, f"page_id {kind}, url string, host string, prefix long")
    answers = asked.join(repeated, ["host", "prefix"]).groupBy("page_id", "url").agg(F.collect_set("prefix").alias("repeated"))  # a page's own

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_kept(found, set(r or ())) for found, r in zip(b.column("blocks").to_pylist(), b.column("repeated").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), strings(texts), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    answers = answers.toDF("_p", "_u", "repeated")
    out = read.join(answers, read.page_id.eqNullSafe(F.col("_p")) & read.url.eqNullSafe(F.col("_u")), "left").select("page_id", "url", "blocks", "repeated")
    return out.mapInArrow(clean, f"page_id {kind}, url string, text string, n_chars long")
