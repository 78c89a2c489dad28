"""Operator 7: order-preserving packing of documents into sequences.

The documents of a partition, in their order, are one stream of tokens.
Windows of at most `size` tokens cut it; a cut may lie at a document's end
(free), at a sentence's end (`sentence_cut`) or, where sentences are long,
inside one (`inner_cut`). Dynamic programming finds the cuts with the least
sum of padding and these penalties: padding is linear in a window's length,
so the best earlier cut is a minimum over a sliding range, kept in a monotone
queue. A window whose length is a power of two has no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lithos.llm.common import PIECE_BYTES, pieces
from lithos.llm.tokens import WordTokenizer

#: Tokens of padding that a cut inside a document costs.
SENTENCE_CUT, INNER_CUT = 8, 24
#: Cuts are offered this often inside sentences of more than twice as many tokens.
INNER_STEP = 64
#: Windows at the end of a stretch that wait for the next stretch.
HELD_BACK = 6
#: Ends of sentences, as words of the vocabulary.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>", "...</w>", "!!</w>", ".\"</w>", ".)</w>")


def windows(cuts: list[int], prices: list[int], size: int) -> list[int]:
    """Indices into `cuts` of the cheapest windows' ends.

    cuts: ascending from 0, steps of `size` at most; prices: of a cut there.
    Ties go to the earliest cut that is met.
    """
    n = len(cuts)
    best, back = [0] * n, [0] * n
    where = {c: i for i, c in enumerate(cuts)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + cut, index), rising
    for j in range(1, n):
        at = cuts[j]
        while at - cuts[queue[0][1]] > size:
            queue.popleft()
        value, i = queue[0]
        value += size - at
        for p in powers:
            k = where.get(at - p)
            if k is not None and best[k] < value:
                value, i = best[k], k
        value += prices[j]
        best[j], back[j] = value, i
        key = value + at
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, start: int = 0) -> tuple[list[int], list[int]]:
    """Cuts of the stretch ids[start:] counted from its start, and their prices."""
    ends = doc_ends[doc_ends > start] - start
    sentence = np.flatnonzero(enders[ids[start:]]) + 1
    points = np.unique(np.concatenate([[0], sentence, ends, [len(ids) - start]]))
    price = np.full(len(points), SENTENCE_CUT)
    gaps = np.diff(points)
    wide = np.flatnonzero(gaps > 2 * INNER_STEP)
    if len(wide):
        inner = np.concatenate([np.arange(points[g] + INNER_STEP, points[g + 1], INNER_STEP) for g in wide])
        points, price = np.concatenate([points, inner]), np.concatenate([price, np.full(len(inner), INNER_CUT)])
        order = np.argsort(points, kind="stable")
        points, price = points[order], price[order]
    price[np.isin(points, ends)] = 0
    price[0] = 0
    return points.tolist(), price.tolist()


def pack(docs: DataFrame, key: str, text: str, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each partition of `docs` packs its own rows in their order: no shuffle,
    and one stretch of a few megabytes in memory. A document is its token ids
    and `end_id`; a null or empty text is that id alone. Every id lies in one
    piece. sequence_id is the partition and a count in it, unique but with
    gaps. Repeated rows are packed again; a null key stays null; no rows give
    no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    cache: dict[str, tuple[WordTokenizer, np.ndarray]] = {}

    def tools() -> tuple[WordTokenizer, np.ndarray]:
        if not cache:
            t = WordTokenizer(tokenizer_path)
            enders = np.zeros(len(t.ends) + end_id + 1, bool)
            enders[[i for w in SENTENCE_ENDS if (i := t.library.token_to_id(w)) is not None]] = True
            cache["t"] = t, enders
        return cache["t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        done = 0
        ids, doc_ends, keys = np.zeros(0, np.uint32), np.zeros(0, np.int64), []
        first_start = 0  # tokens of the first document held that earlier windows have

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, ids, doc_ends, keys, first_start
            if len(ids) == first_start:
                return
            cuts, prices = cut_points(ids, doc_ends, tools()[1], first_start)
            chosen = windows(cuts, prices, size)
            if not last:
                chosen = chosen[:-HELD_BACK]
            if not chosen:
                return
            ends = np.array([cuts[c] for c in chosen]) + first_start
            starts = np.concatenate([[first_start], ends[:-1]])
            doc_starts = np.concatenate([[0], doc_ends[:-1]])
            edges = np.unique(np.concatenate([starts, doc_starts[(doc_starts >= first_start) & (doc_starts < ends[-1])]]))
            stops = np.append(edges[1:], ends[-1])
            doc = np.searchsorted(doc_ends, edges, "right")
            seq = np.searchsorted(ends, edges, "right")
            raw = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(edges, stops, strict=True)]
            columns = [
                pa.array([keys[d] for d in doc], pa_type),
                pa.array(edges - doc_starts[doc]),
                pa.array(stops - edges),
                pa.array(np.array(crc, np.int64)),
                pa.array((doc_ends - doc_starts)[doc]),
                pa.array(part + done + seq),
                pa.array(edges - starts[seq]),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([raw[a:b].astype(np.int32) for a, b in zip(edges, stops, strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            done += len(ends)
            whole = int(np.searchsorted(doc_ends, ends[-1], "right"))  # documents that are packed
            base = int(doc_ends[whole - 1]) if whole else 0
            ids, doc_ends, keys, first_start = ids[base:], doc_ends[whole:] - base, keys[whole:], int(ends[-1]) - base

        pa_type = None
        for b in pieces(batches, "_text", PIECE_BYTES):
            pa_type = b.column("_key").type
            got, offsets = tools()[0].ids(b.column("_text"))
            n = np.diff(offsets)
            stream = np.full(len(got) + len(n), end_id, np.uint32)
            own_ends = np.cumsum(n + 1)
            inside = np.ones(len(stream), bool)
            inside[own_ends - 1] = False
            stream[inside] = got
            doc_ends = np.concatenate([doc_ends, own_ends + len(ids)])
            ids = np.concatenate([ids, stream])
            keys += b.column("_key").to_pylist()
            if len(ids) - first_start >= 64 * size:
                yield from emit(False)
        yield from emit(True)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{key}` as _key", f"`{text}` as _text").mapInArrow(run, schema)
