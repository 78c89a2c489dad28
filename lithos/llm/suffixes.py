"""Operator 8: removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a SPAN-byte string over it also starts in a document with a
smaller doc_id. Suffixes of the whole corpus need not be sorted as one: two
equal SPAN-byte strings have the same anchor, the SEED-byte string in them
with the least hash, so suffixes are dealt to buckets by the anchor's hash,
and only a few hundredths of all positions are anchors.

1. Each chunk of documents sends short hashes of its anchors to their buckets,
   which answer with a bit for each: whether two documents have it.
2. Around these, chunks send the context: all bytes that SPAN-byte strings
   with this anchor can have. Where a bucket has one context only for an
   anchor, its smallest doc_id decides. Where there are several, the bucket
   sorts all suffixes of the contexts by a difference cover modulo 3 (sort the
   triples of the sampled suffixes, recurse on their names, merge the rest)
   and compares the prefixes of neighbours, which finds all equal strings and
   the smallest doc_id of each.
3. Chunks mark the strings that the answers call repeated.

Chunks and buckets are bounded in bytes; an anchor that a third of all
documents share is one entry of each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import U64, Rolling, flat, mix, owners

SPAN, SEED = 50, 28
_REACH = SPAN - SEED
_CONTEXT = SPAN + _REACH
#: No byte of UTF-8: what lies outside of a document.
_OUT = 0xFF
#: Text of a chunk, and text whose anchors a bucket holds, in bytes on average.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Contexts whose suffixes are sorted at once; one anchor's are never parted.
SORTED = 4_000


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One integer an element, ordered as the columns are, the first one first."""
    out = columns[0].astype(np.int64)
    for column in columns[1:]:
        size = int(column.max()) + 1
        if int(out.max()) >= (1 << 62) // size:
            out = np.unique(out, return_inverse=True)[1]
        out = out * size + column
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (non-negative integers) in order, by the skew algorithm of Kärkkäinen and Sanders."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    narrow = np.int32 if max(n, int(s.max())) < (1 << 31) - 8 else np.int64
    t = np.zeros(n + 3, narrow)
    t[:n] = s
    t[:n] += 1
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3, n // 3
    extra = n0 - n1  # a sample more, of the empty suffix, if n mod 3 is 1
    order = np.concatenate([np.arange(1, n + extra, 3, dtype=narrow), np.arange(2, n, 3, dtype=narrow)])
    triples = _packed(t[order], t[order + 1], t[order + 2])
    by_triple = np.argsort(triples)
    order, triples = order[by_triple], triples[by_triple]
    names = np.ones(len(order), narrow)
    names[1:] += np.cumsum(triples[1:] != triples[:-1], dtype=narrow)
    del triples, by_triple
    split = n0  # samples of residue 1
    place = np.where(order % 3 == 1, order // 3, order // 3 + split)
    del order
    if names[-1] < len(place):
        recursed = np.zeros(len(place), narrow)
        recursed[place] = names
        del names, place  # what is held during the recursion counts
        place = suffix_array(recursed)
        del recursed
    sa12 = np.where(place < split, place * 3 + 1, (place - split) * 3 + 2)
    del place
    rank = np.zeros(n + 3, narrow)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    # a suffix of residue 0 compares with one of residue 1 by its first letter and the next one's rank, with one of residue 2 by two letters and a rank
    sa0, residue = np.arange(0, n, 3, dtype=narrow), sa12 % 3
    key = _packed(t[:n], rank[1 : n + 1])
    sa0 = sa0[np.argsort(key[sa0])]
    lo = np.searchsorted(key[sa12[residue == 1]], key[sa0])
    key = _packed(t[:n], t[1 : n + 1], rank[2 : n + 2])
    lo += np.searchsorted(key[sa12[residue == 2]], key[sa0])
    del key, residue
    out = np.zeros(n, narrow)
    at = lo + np.arange(len(sa0))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = sa0, sa12
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all SPAN-byte strings inside a document, the start of each one's anchor, and the hashes of the SEED-byte strings by start."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    hashes = Rolling(data).windows(SEED)
    where = np.zeros(len(hashes) - _REACH, np.int32)
    for at in range(0, len(where), _BLOCK):
        least = hashes[at : at + _BLOCK + _REACH]
        place = np.arange(at, at + len(least), dtype=np.int32)
        for step in (1, 2, 4, 8, _REACH - 15):
            left = least[:-step] <= least[step:]
            least, place = np.minimum(least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
        where[at : at + len(place)] = place
    ends = np.minimum(offsets[1:] - SPAN + 1, len(where))
    steps = np.zeros(len(where) + 1, np.int32)
    some = ends > offsets[:-1]
    np.add.at(steps, offsets[:-1][some], 1)
    np.add.at(steps, ends[some], -1)
    inside = np.cumsum(steps[:-1]) > 0
    starts = np.flatnonzero(inside)
    return starts, where[starts].astype(np.int64), hashes


def contexts(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(anchors, _CONTEXT) bytes around each anchor, _OUT outside of its document."""
    if not len(at):
        return np.zeros((0, _CONTEXT), np.uint8)
    padded = np.pad(data, (_REACH, SPAN))
    out = np.lib.stride_tricks.sliding_window_view(padded, _CONTEXT)[at]
    before, after = at - offsets[doc], offsets[doc + 1] - at  # bytes of the document on either side
    edge = np.flatnonzero((before < _REACH) | (after < SPAN))
    place = np.arange(-_REACH, SPAN)
    part = out[edge]
    part[(place < -before[edge][:, None]) | (place >= after[edge][:, None])] = _OUT
    out[edge] = part
    return out


def context_hashes(ctx: np.ndarray) -> np.ndarray:
    """Of the bytes of each row."""
    words = np.ascontiguousarray(np.pad(ctx, ((0, 0), (0, -ctx.shape[1] % 8)))).view(U64)
    out = np.zeros(len(ctx), U64)
    for j in range(words.shape[1]):
        out = mix(out ^ words[:, j] * U64(0x9E3779B97F4A7C15) ^ U64(j))
    return out


def repeated_masks(ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bit o of a context: its SPAN-byte string at o is also in a context of a smaller doc."""
    n = len(ctx)
    text = np.concatenate([ctx, np.full((n, 1), 256, ctx.dtype if ctx.dtype != np.uint8 else np.uint16)], axis=1).ravel()
    order = suffix_array(text)
    order = order[order % (_CONTEXT + 1) <= _REACH].astype(np.int64)
    del text
    rows, shift = order // (_CONTEXT + 1), order % (_CONTEXT + 1)
    size = np.full(len(order), 0)
    for at in range(0, len(order), 1 << 16):  # prefixes of neighbours
        part = slice(at, at + (1 << 16))
        here = ctx[rows[part][:, None], shift[part][:, None] + np.arange(SPAN)]
        size[part] = (here != _OUT).all(1)
        same = (here[1:] == here[:-1]).all(1)
        size[part][1:] |= same.astype(size.dtype) << 1
        if at:
            size[at] |= int((here[0] == last).all()) << 1
        last = here[-1]
    group = np.cumsum((size & 2) == 0) - 1
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[rows])
    hit = ((size & 1) == 1) & (least[group] < doc[rows])
    out = np.zeros(n, U64)
    np.bitwise_or.at(out, rows[hit], U64(1) << shift[hit].astype(U64))
    return out


#: Positions whose minima are found at once, in the processor's cache.
_BLOCK = 1 << 14


def _zstd() -> pa.Codec:
    """Contexts overlap and are text: half of what the shuffle's own compression leaves."""
    return pa.Codec("zstd", 3)


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the places of their hashes."""
    bucket = ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]])) if len(order) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _joined(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // width


class _Chunk:
    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("doc_id").to_numpy()
        self.data, self.offsets = flat(table.column("text"))
        self.starts, self.anchor, self.hashes = anchors(self.data, self.offsets)
        fresh = np.ones(len(self.anchor), bool)
        fresh[1:] = self.anchor[1:] != self.anchor[:-1]  # anchors never go back: of equal ones the first is taken
        self.at, self.mine = self.anchor[fresh], np.cumsum(fresh, dtype=np.int32) - 1
        self.row = np.searchsorted(self.offsets, self.at, "right") - 1
        self.h = self.hashes[self.at] if len(self.at) else np.zeros(0, U64)


def remove_repeats(docs: DataFrame, key: str, text: str, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the bytes kept.

    Texts are UTF-8 bytes and strings never cross documents; a null text is
    empty. Rows that share a doc_id don't count as repeats of each other. A
    null doc_id is not smaller than any, nor any smaller than it: nothing is
    removed from or because of such a row. No rows give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = int(total // CHUNK_BYTES + 1), int(total // BUCKET_BYTES + 12)
    dealt = rows.where("doc_id is not null").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    dealt = dealt.repartition(max(12, chunks), "chunk")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        order = np.lexsort((c.ids[c.row], c.h))
        h, doc = c.h[order], c.ids[c.row][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = doc[np.append(first[1:], len(h)) - 1] != doc[first] if len(h) else np.zeros(0, bool)
        h = h[first]
        # inside a bucket 31 bits will do: a false match costs a context that the bucket then tells apart
        short = ((h & U64(0x7FFFFFFF)) << U64(1) | several.astype(U64)).astype(np.uint32)
        out = [(b, key[0].as_py(), short[i].tobytes()) for b, i in _by_bucket(h, buckets)]
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "chunk", "h"])

    def shared(table: pa.Table) -> pa.Table:
        h, n = _joined(table.column("h"), np.uint32)
        several, h = (h & 1).astype(bool), h >> 1
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(s)))
        good = (count > 1) | (np.maximum.reduceat(several[order], first) if len(s) else False)
        hit = np.zeros(len(h), bool)
        hit[order] = np.repeat(good, count)
        ends = np.cumsum(n)
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(ends - n, ends, strict=True)]
        return pa.table([*[table.column(k).cast(pa.int32()) for k in ("chunk", "bucket")], pa.array(bits, pa.binary())], ["chunk", "bucket", "hits"])

    def show(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        out = []
        if len(table) and len(answer):
            c = _Chunk(table)
            asked = np.unique(c.h)  # each bucket's part in the order in which it was asked
            hits = dict(zip(answer.column("bucket").to_pylist(), answer.column("hits").to_pylist(), strict=True))
            good = np.zeros(len(asked), bool)
            for b, i in _by_bucket(asked, buckets):
                good[i] = np.unpackbits(np.frombuffer(hits[b], np.uint8), count=len(i))
            some = np.flatnonzero(good[np.searchsorted(asked, c.h)]) if len(asked) else np.zeros(0, np.int64)
            h, ctx, doc = c.h[some], contexts(c.data, c.offsets, c.row[some], c.at[some]), c.ids[c.row[some]]
            by_context = context_hashes(ctx)
            order = np.lexsort((doc, by_context, h))
            name = by_context[order]
            order = order[np.concatenate([[True], name[1:] != name[:-1]])] if len(order) else order
            h, ctx, doc = h[order], ctx[order], doc[order]
            out = [(b, key[0].as_py(), _zstd().compress(ctx[i].tobytes(), asbytes=True), doc[i].astype(np.int64).tobytes()) for b, i in _by_bucket(h, buckets)]
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["bucket", "chunk", "ctx", "doc"])

    def decide(table: pa.Table) -> pa.Table:
        doc, n = _joined(table.column("doc"), np.int64)
        packed = table.column("ctx")
        ctx = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(_zstd().decompress(x.as_buffer(), k * _CONTEXT), np.uint8) for x, k in zip(packed, n.tolist(), strict=True))]).reshape(-1, _CONTEXT)
        h = context_hashes(ctx[:, _REACH:SPAN])
        name = context_hashes(ctx)
        order = np.lexsort((doc, name, h))
        fresh_h = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        fresh = fresh_h | np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(h) else fresh_h
        kind = np.zeros(len(h), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        rep = order[fresh]  # of each context, an entry with its smallest doc
        anchor = (np.cumsum(fresh_h) - 1)[fresh]
        many = np.bincount(anchor)[anchor] > 1 if len(rep) else np.zeros(0, bool)
        mask = np.zeros(len(rep), U64)
        some = np.flatnonzero(many)  # anchor by anchor: equal strings have the same
        edges = np.flatnonzero(np.concatenate([[True], np.diff(anchor[some]) > 0])) if len(some) else np.zeros(0, np.int64)
        edges = np.append(edges, len(some))
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + SORTED, "right")) - 1)
            part = some[edges[at] : edges[to]]
            mask[part] = repeated_masks(ctx[rep[part]], doc[rep[part]])
            at = to
        least, own = doc[rep][kind], mask[kind]
        ends = np.cumsum(n)
        cuts = list(zip(ends - n, ends, strict=True))
        return pa.table(
            [table.column("chunk").cast(pa.int32()), *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (name, least, own)]],
            ["chunk", "name", "least", "mask"],
        )

    def remove(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        c = _Chunk(table)
        gone = np.zeros(len(c.data) + 1, np.int32)
        if len(answer) and len(c.at):
            names, least, mask = (_joined(answer.column(k), t)[0] for k, t in (("name", U64), ("least", np.int64), ("mask", U64)))
            order = np.argsort(names, kind="stable")
            names, least, mask = names[order], least[order], mask[order]
            # only anchors that were shown can have an answer
            name = np.zeros(len(c.at), U64)
            for at in range(0, len(c.at), 1 << 16):
                part = slice(at, at + (1 << 16))
                name[part] = context_hashes(contexts(c.data, c.offsets, c.row[part], c.at[part]))
            place = np.minimum(np.searchsorted(names, name), max(0, len(names) - 1))
            known = names[place] == name if len(names) else np.zeros(len(name), bool)
            doc = c.ids[c.row]
            whole = known & (doc > least[place]) if len(names) else known
            bits = np.where(known & ~whole, mask[place], U64(0)) if len(names) else np.zeros(len(name), U64)
            shift = (c.starts - c.anchor + _REACH).astype(U64)
            hit = c.starts[whole[c.mine] | ((bits[c.mine] >> shift) & U64(1)).astype(bool)]
            gone[hit] += 1
            gone[hit + SPAN] -= 1
        return _report(c.ids, c.data, c.offsets, np.cumsum(gone[:-1]) > 0)

    def _report(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> pa.Table:
        n = np.diff(offsets)
        count = np.concatenate([[0], np.cumsum(out)])
        head = out.copy()
        head[1:] &= ~out[:-1]
        inner = offsets[:-1][offsets[:-1] < len(out)]
        head[inner] = out[inner]
        spans = np.concatenate([[0], np.cumsum(head)])
        kept = [data[a:b][~out[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [pa.array(ids, pa.int64(), from_pandas=True), pa.array(n), pa.array(count[offsets[1:]] - count[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.table(columns + [pa.array(kept, pa.binary())] * with_kept, names + ["kept"] * with_kept)

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    asked = dealt.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, h binary")
    answered = asked.groupBy("bucket").applyInArrow(shared, "chunk int, bucket int, hits binary")
    shown = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(show, "bucket int, chunk int, ctx binary, doc binary")
    decided = shown.groupBy("bucket").applyInArrow(decide, "chunk int, name binary, least binary, mask binary")
    out = dealt.groupBy("chunk").cogroup(decided.groupBy("chunk")).applyInArrow(remove, result)
    loose = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"), *[F.encode("text", "utf-8").alias("kept")] * with_kept)
    return out.unionByName(loose)
