"""Operator 10: benchmark decontamination by CGK embedding and bit sampling.

An item of n words is looked for among the windows of n words of every
document: a document leaks it if some window is within edit distance (in
words) of floor((1 - SIMILARITY) n). Every such window holds most of the item's
word pairs, so the places of each item's pairs rule out all other windows without
loss. The windows left are embedded by CGK random walks (walk
along a string, copying its symbol at each of 3n steps and moving on by a
random bit of step and symbol), under which strings at a small edit distance
agree in most steps. Repeated samples of steps are hashed and looked up
among the items' own; every match is verified by exact edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import U64, mix, owners, pieces, ragged, seeded, word_hashes

SIMILARITY = 0.8
#: Items of fewer words are not looked for.
MIN_WORDS = 5
#: Walks, samples of each walk, and steps in a sample.
WALKS, SAMPLES, STEPS = 6, 24, 3
#: UTF-8 bytes of items that one scan of the documents looks for; more items, more scans.
BLOCK_BYTES = 16 << 20
#: log2 of the cells of the table of word pairs.
TABLE_BITS = 22
#: Words that are searched at once.
SEARCH_WORDS = 2 << 20
#: Windows that are embedded at once.
WINDOWS = 4096


def edits(n: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * n + 1e-9))


def walk_keys(strings: np.ndarray, walk: int) -> np.ndarray:
    """(rows, SAMPLES) hashes of sampled steps of one CGK walk along each row of words."""
    rows, n = strings.shape
    length = 3 * n
    padded = np.concatenate([strings, np.zeros((rows, 1), U64)], axis=1)
    salt = seeded(length, 1000 + walk)
    picks = (seeded(SAMPLES * STEPS, 2000 + walk) % U64(length)).astype(np.int64).reshape(SAMPLES, STEPS)
    where = np.zeros(rows, np.int64)
    every = np.arange(rows)
    used = np.unique(picks)
    seen = np.zeros((int(used[-1]) + 1, rows), U64)
    for t in range(int(used[-1]) + 1):
        symbol = padded[every, where]
        seen[t] = symbol
        where = np.minimum(where + (mix(symbol ^ salt[t]) & U64(1)).astype(np.int64), n)
    out = np.zeros((rows, SAMPLES), U64)
    for s in range(SAMPLES):
        h = np.full(rows, s + 1, U64)
        for t in picks[s]:
            h = mix(h ^ seen[t])
        out[:, s] = h
    return out


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each row of x to the same row of y."""
    return _distances(*small_words(x, y))


def small_words(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same arrays with words numbered in few bits."""
    names = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)[1]
    small = np.int16 if len(names) and names.max() < 1 << 15 and x.shape[1] + y.shape[1] < 1 << 14 else np.int32
    return names[: x.size].astype(small).reshape(x.shape), names[x.size :].astype(small).reshape(y.shape)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    # a column of the table at a time, all rows side by side
    (rows, n), small = x.shape, x.dtype.type
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    m = len(ys)
    row = np.repeat(np.arange(m + 1, dtype=small)[:, None], rows, axis=1)
    new = np.empty_like(row)
    one = small(1)
    for i in range(n):
        new[0] = i + 1
        np.minimum(row[1:] + one, row[:-1] + (ys != xs[i]), out=new[1:])
        for j in range(m):
            np.minimum(new[j + 1], new[j] + one, out=new[j + 1])
        row, new = new, row
    return row[-1].astype(np.int64)


class Items:
    """Items of one block, by length, with the table of their word pairs and the keys of their walks."""

    def __init__(self, ids: list[int], texts: list[str | None], similarity: float):
        words, offsets = word_hashes(pa.array(texts, pa.string()))
        self.similarity = similarity
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups = defaultdict(list)
        for i, n in enumerate(np.diff(offsets)):
            if n >= MIN_WORDS:
                groups[int(n)].append(i)
        self.pairs = np.zeros(1 << TABLE_BITS, bool)
        for n, rows in sorted(groups.items()):
            strings = words[offsets[rows][:, None] + np.arange(n)]
            self.by_length[n] = np.array([ids[r] for r in rows], np.int64), strings
            self.pairs[self.cells(strings.ravel())[np.arange(strings.size - 1) % n != n - 1]] = True
        # items of all lengths, numbered in order of length: their lengths, and those of each pair
        self.lengths = np.concatenate([np.full(len(x), n) for n, (_, x) in self.by_length.items()]) if self.by_length else np.zeros(0, np.int64)
        self.least = np.array([n - 1 - 2 * edits(n, similarity) for n in self.lengths.tolist()], np.int64)
        pairs, owner, before = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
        for n, (_, strings) in self.by_length.items():
            pairs.append(self.hashes(strings.ravel())[np.arange(strings.size - 1) % n != n - 1])
            owner.append(np.repeat(np.arange(len(strings)), n - 1) + before)
            before += len(strings)
        own_pairs, own = np.concatenate(pairs), np.concatenate(owner)
        order = np.lexsort((own, own_pairs))
        own_pairs, own = own_pairs[order], own[order]
        fresh = np.concatenate([[True], (own_pairs[1:] != own_pairs[:-1]) | (own[1:] != own[:-1])])[: len(own)]
        own_pairs, self.owner = own_pairs[fresh], own[fresh]
        first = np.flatnonzero(np.concatenate([[True], own_pairs[1:] != own_pairs[:-1]])[: len(own_pairs)])
        self.known, self.bounds = own_pairs[first], np.append(first, len(own_pairs))
        self.keys = {n: [self._table(walk_keys(strings, w)) for w in range(WALKS)] for n, (_, strings) in self.by_length.items()}

    @staticmethod
    def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        items = np.repeat(np.arange(len(keys)), keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        return keys.ravel()[order], items[order]

    @staticmethod
    def hashes(words: np.ndarray) -> np.ndarray:
        """Of each pair of neighbours."""
        return mix(words[:-1] * U64(3) + words[1:])

    @classmethod
    def cells(cls, words: np.ndarray) -> np.ndarray:
        return (cls.hashes(words) >> U64(64 - TABLE_BITS)).astype(np.int64)

    def worth(self, words: np.ndarray, hit: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the starts of windows with enough pairs of some one item of that length. hit: places of pairs that may be an item's.

        For each item the places of its pairs are in order; where the first
        and last of as many as are needed lie within its length, so do the windows over them.
        """
        own = mix(words[hit] * U64(3) + words[hit + 1])
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        hit, at = hit[self.known[at] == own], at[self.known[at] == own]
        many = self.bounds[at + 1] - self.bounds[at]
        place, item = np.repeat(hit, many), self.owner[ragged(self.bounds[at], many)]
        order = np.argsort(item.astype(np.int32), kind="stable")
        place, item = place[order], item[order]
        last = np.arange(len(item)) + self.least[item] - 1
        inside = np.flatnonzero(last < len(item))
        inside = inside[(item[last[inside]] == item[inside]) & (place[last[inside]] - place[inside] <= self.lengths[item[inside]] - 2)]
        n, lo, hi = self.lengths[item[inside]], place[last[inside]] - self.lengths[item[inside]] + 2, place[inside]
        lo = np.maximum(lo, 0)
        return {int(k): np.unique(ragged(lo[n == k], hi[n == k] - lo[n == k] + 1)) for k in np.unique(n)}

    def matches(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of every match that the samples find."""
        _, strings = self.by_length[n]
        found = []
        for w in range(WALKS):
            keys, items = self.keys[n][w]
            own = walk_keys(windows, w)
            lo, hi = np.searchsorted(keys, own.ravel(), "left"), np.searchsorted(keys, own.ravel(), "right")
            hits = hi - lo
            window = np.repeat(np.repeat(np.arange(len(windows)), SAMPLES), hits)
            found.append(window * len(strings) + items[ragged(lo, hits)])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(strings), pair % len(strings)
        distance = np.zeros(len(pair), np.int64)
        x, y = small_words(windows, strings)
        for at in range(0, len(pair), 1 << 12):
            distance[at : at + (1 << 12)] = _distances(x[window[at : at + (1 << 12)]], y[item[at : at + (1 << 12)]])
        good = distance <= edits(n, self.similarity)
        return window[good], item[good], distance[good]

    def search(self, words: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Rows (document, item, start, words, distance), the nearest and first window of each document and item."""
        out = []
        if len(words) < MIN_WORDS or not self.by_length:
            return out
        last = np.zeros(len(words), bool)
        last[(offsets[1:] - 1)[np.diff(offsets) > 0]] = True
        hit = self.pairs[self.cells(words)] & ~last[:-1]
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(words))  # words to the row's end
        row = owners(offsets)
        for n, starts in self.worth(words, np.flatnonzero(hit)).items():
            ids, _ = self.by_length[n]
            starts = starts[left[starts] >= n]
            for at in range(0, len(starts), WINDOWS):
                own = starts[at : at + WINDOWS]
                window, item, distance = self.matches(n, words[own[:, None] + np.arange(n)])
                if len(window):
                    where = own[window]
                    out.append(np.stack([row[where], ids[item], where - offsets[row[where]], np.full(len(where), n), distance], axis=1))
        return out


def _scan(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_BYTES of text at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for b in pieces(batches, "text", 2 << 20):
            held.append((b.column("doc_id"), *word_hashes(b.column("text"))))
            if sum(len(words) for _, words, _ in held) >= SEARCH_WORDS:
                yield from found(held)
                held = []
        if held:
            yield from found(held)

    def found(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0, *[len(words) for _, words, _ in held]])
        offsets = np.concatenate([[0], *[o[1:] + n for (_, _, o), n in zip(held, before[:-1], strict=True)]])
        rows = shared.value.search(np.concatenate([words for _, words, _ in held]), offsets)
        if not rows:
            return
        x = np.concatenate(rows)
        x = x[np.lexsort((x[:, 2], x[:, 4], x[:, 1], x[:, 0]))]
        x = x[np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])]
        ids = pa.chunked_array([i for i, _, _ in held]).take(pa.array(x[:, 0])).combine_chunks()
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x[:, j]) for j in (1, 2, 3, 4)], pa.array(1.0 - x[:, 4] / x[:, 3])], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

    return docs.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): a row for each document and item that it holds.

    Words are runs of letters, digits and `_` in lower case, so punctuation
    and line breaks don't count. Documents are scanned once for each block of
    BLOCK_BYTES of items, without a shuffle. Null texts hold nothing; items
    that are null or have fewer than MIN_WORDS words are not looked for;
    repeated rows are reported again; a null doc_id stays null.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids, texts, size, out = [], [], 0, None
    for r in items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").toLocalIterator():
        ids.append(r["i"] if r["i"] is not None else -1)
        texts.append(r["t"])
        size += len(r["t"].encode())
        if size >= BLOCK_BYTES:
            part = _scan(rows, Items(ids, texts, similarity))
            out, ids, texts, size = part if out is None else out.union(part), [], [], 0
    part = _scan(rows, Items(ids, texts, similarity))
    return part if out is None else out.union(part)
