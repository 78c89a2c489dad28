"""Fast exact token ids of a word-end byte-pair vocabulary, over Arrow columns.

The library's own encoder spends most of its time on normalising and
splitting. Here both run in numpy over code points, every distinct word of a
piece is merged once, and the ids are gathered back. The merges run in a second
encoder over the same vocabulary: a word's end is written as one marker
byte, whose pairs with single bytes have the lowest ranks and so merge first,
which gives the vocabulary's word-end symbols. Rows that this can't hold
(the marker itself, letters whose lower case is longer) go to the library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from lithos.llm.common import U64, _powers, flat, mix, owners, ragged, seeded

_MARK = "\x01"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _byte_of() -> dict[str, int]:
    """Byte of each printable stand-in of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its class, its lower case, and whether that is longer than one."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    longer = np.zeros(0x110000, bool)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = lambda i: i if i < 0xD800 else i + 0x800
    for name, value in ((r"\p{White_Space}+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(name, points):
            kind[at(m.start()) : at(m.end() - 1) + 1] = value
    for m in regex.finditer(r"[\p{Lu}\p{Lt}\p{Changes_When_Lowercased}]", points):
        c = m.group().lower()
        if len(c) == 1:
            lower[ord(m.group())] = ord(c)
        else:
            longer[ord(m.group())] = True
    return kind, lower, longer


class WordTokenizer:
    """ids(column) equals the library's encode_batch(..., add_special_tokens=False) on it."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = _byte_of()
        special = set(self.library.get_added_tokens_decoder())
        ranks: dict[bytes, int] = {}
        self.ends = np.zeros(max(vocab.values()) + 2, bool)
        for word, i in vocab.items():
            if i in special:
                continue
            end = word.endswith("</w>") and word != "</w>"
            ranks[bytes(byte_of[c] for c in (word[:-4] if end else word)) + _MARK.encode() * end] = i
            self.ends[i] = end
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.kind, self.lower, self.longer = _classes()
        self.salt = seeded(1, 23)[0]

    def _starts(self, points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a word starts here; space is no word."""
        start = kind != _SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        inner = offsets[:-1][offsets[:-1] < len(points)]
        start[inner] = kind[inner] != _SPACE
        quotes = np.flatnonzero(start & (points == 0x27))
        if len(quotes):
            row_end = offsets[np.searchsorted(offsets, quotes, "right")]
            ahead = [np.where(quotes + k < row_end, points[np.minimum(quotes + k, len(points) - 1)], 0) for k in (1, 2)]
            one = np.isin(ahead[0], [ord(c) for c in "stmd"])
            two = np.zeros(len(quotes), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
            hit = one | two
            start[quotes[hit] + 1] = False
            start[quotes[two] + 2] = False
            after = quotes[hit] + np.where(two[hit], 3, 2)
            after = after[after < row_end[hit]]
            start[after] = kind[after] != _SPACE
        return start

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows one after another (a null row is empty), and the n+1 offsets."""
        data, _ = flat(column)
        points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
        counts = pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if len(points) and points.max() >= 0x300:  # below, every text is in composed form
            rows = np.unique(owners(offsets)[points >= 0x300])
            values = column.to_pylist()
            fixed = {r: v for r in rows if (v := unicodedata.normalize("NFC", values[r])) != values[r]}
            if fixed:
                return self.ids(pa.array([fixed.get(r, v) for r, v in enumerate(values)], pa.string()))
        odd = np.unique(owners(offsets)[self.longer[points] | (points == 1)]) if len(points) else []
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        points = np.where(points == 1, 0x21, self.lower[points])  # rows with a marker are replaced below
        kind = self.kind[points]
        starts = np.flatnonzero(self._starts(points, kind, offsets))
        stops = np.append(starts[1:], len(points))
        # a word stops at the next one's start, or before at white space or the row's end
        space = np.flatnonzero(kind == _SPACE)
        if len(space):
            stops = np.minimum(stops, np.append(space, len(points))[np.searchsorted(space, starts)])
        stops = np.minimum(stops, offsets[np.searchsorted(offsets, starts, "right")])
        up, down = _powers(len(points))
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum(mix(points.astype(U64) + self.salt) * up[: len(points)], out=sums[1:])
        hashes = mix((sums[stops] - sums[starts]) * down[starts])
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        pool, pool_starts, pool_lengths = self._merge(points, starts[first], stops[first])
        lengths = pool_lengths[inverse]
        out = pool[ragged(pool_starts[inverse], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out_offsets = ends[np.searchsorted(starts, offsets)]
        if len(odd):
            texts = column.take(pa.array(odd)).to_pylist()
            own = {r: np.array(e.ids, np.uint32) for r, e in zip(odd, self.library.encode_batch(texts, add_special_tokens=False), strict=True)}
            rows = [own.get(r, out[out_offsets[r] : out_offsets[r + 1]]) for r in range(len(column))]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return out, out_offsets

    def _merge(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these words one after another, and each word's start and count."""
        lengths = stops - starts
        text = np.ones(int(lengths.sum()) + len(lengths), np.uint32)
        to = np.cumsum(lengths + 1) - lengths - 1
        text[ragged(to, lengths)] = points[ragged(starts, lengths)]
        ids = np.array(self.merger.encode_ordinary(text.tobytes().decode("utf-32-le", "replace")), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        first = np.concatenate([[0], last[:-1] + 1])
        return ids, first, last + 1 - first
