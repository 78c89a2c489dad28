"""Operator 2: near-duplicates by BagMinHash.

A document is the bag of its five-word shingles. Its signature has SLOTS
slots, each hit by a Poisson process in time for every unit of weight of every
shingle; a slot keeps its first hit. The processes are hierarchical: weights
are cut at 1, 2, 4, 8, ...; the points of one stretch (lo, hi] are drawn
at its whole rate, each with a height in it, and a shingle of weight w takes
those of height w or less. Points are drawn in order of time, and no more
once they come later than the last slot's first hit. Two bags agree in a slot
with probability equal to their weighted Jaccard similarity.

Slots are banded; documents that share a band are candidates, and the exact
overlap of their bags decides. Linked documents form groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.buckets import MARK_WORDS, bucket_links, bucket_members, lacking
from lithos.llm.common import U64, checkpointed, flat, mix, owners, pieces, ragged, seeded, shingle_hashes, word_hashes
from lithos.llm.components import connected_components

SHINGLE = 5
#: Least weighted Jaccard similarity of a link.
SIMILARITY = 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8**4)**25 = 2e-6.
BANDS, ROWS = 25, 4
SLOTS = BANDS * ROWS
#: Classes of shingles by which two bags' overlap is bounded.
MARKS = 64 * MARK_WORDS

_NONE = np.inf


def bags(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles of each row, ascending, with their counts; the row offsets; and a 128-bit hash of each row's words."""
    words, offsets = word_hashes(column)
    hashes, at = shingle_hashes(words, offsets, k)
    row = owners(at).astype(U64)
    keys = np.sort((row << U64(48)) | (hashes >> U64(16)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    bounds = np.searchsorted(keys[first], np.arange(len(column) + 1, dtype=U64) << U64(48))
    place = np.arange(len(words), dtype=U64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(U64)
    identity = np.zeros((len(column), 2), U64)
    for j in range(2):
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(mix(words ^ mix(place + seeded(2, 31)[j])), out=sums[1:])
        identity[:, j] = mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64))
    return keys[first] & U64((1 << 48) - 1), counts, bounds, identity


def signatures(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(rows, slots) names of the points that come first in each slot; 0 where a row has no shingle."""
    rows = len(offsets) - 1
    first = np.full(rows * slots, _NONE)
    name = np.zeros(rows * slots, U64)
    row = owners(offsets)
    doc, state, lo, hi, weight = [row], [mix(shingles * U64(2) + U64(1))], [np.zeros(len(row))], [np.ones(len(row))], [weights]
    level = 1
    while len(more := np.flatnonzero(weights > level)):
        doc.append(row[more])
        state.append(mix((shingles[more] * U64(2) + U64(1)) ^ mix(np.full(1, level * 2, U64))))
        lo.append(np.full(len(more), float(level)))
        hi.append(np.full(len(more), float(2 * level)))
        weight.append(weights[more])
        level *= 2
    doc, state, lo, hi, weight = (np.concatenate(x) for x in (doc, state, lo, hi, weight))
    time = np.zeros(len(doc))
    drawn, batch = 0, 1
    while len(doc):
        # `batch` further points of each process, in order of time
        step = seeded(drawn + batch, 41)[drawn:]
        point = mix(state[:, None] ^ step[None, :])
        gap = -np.log(((point >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (hi - lo)[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        other = mix(point)
        slot = (other >> U64(32)) * U64(slots) >> U64(32)
        height = lo[:, None] + ((other & U64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32 * (hi - lo)[:, None]
        taken = (height <= weight[:, None]).ravel()
        where = (doc[:, None] * slots + slot.astype(np.int64)).ravel()[taken]
        when = times.ravel()[taken]
        np.minimum.at(first, where, when)
        won = when == first[where]
        name[where[won]] = (point.ravel()[taken])[won]
        last = first.reshape(rows, slots).max(1)
        time = times[:, -1]
        on = np.flatnonzero(time < last[doc])
        doc, state, lo, hi, weight, time = (x[on] for x in (doc, state, lo, hi, weight, time))
        drawn += batch
        batch = int(min(64, max(1, (1 << 20) // max(1, len(doc))), 2 * batch))
    return name.reshape(rows, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes; a band's number is part of its key."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = seeded(BANDS, 43)[None, :] + np.zeros((len(signature), 1), U64)
    for j in range(ROWS):
        out = mix(out ^ parts[:, :, j])
    return out.astype(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 2 << 20):
        column = b.column("text")
        shingles, weights, offsets, identity = bags(column)
        bands = band_keys(signatures(shingles, weights, offsets))
        total = np.concatenate([[0], np.cumsum(weights)])[offsets]
        size = np.diff(total)
        data, ends = flat(column)
        wordless = np.flatnonzero(size == 0)
        raw = [hash_text(data[ends[i] : ends[i + 1]]) for i in wordless]  # equal only to the same text
        if raw:
            identity[wordless] = raw
        blank = (size == 0) & (np.diff(ends) == 0)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(identity[:, j].astype(np.int64), mask=blank) for j in (0, 1)], pa.array(size), pa.array(list(np.where((size > 0)[:, None], bands, 0)), pa.list_(pa.int64()))],
            ["doc_id", "c1", "c2", "size", "bands"],
        )


def hash_text(data: np.ndarray) -> tuple[int, int]:
    import hashlib

    digest = hashlib.blake2b(data.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bag as a set: a shingle of count c is the c elements (shingle, 0) to (shingle, c-1). Numbers beyond 16 bits are mixed in, so that none is used twice."""
    for b in pieces(batches, "text", 2 << 20):
        shingles, weights, offsets, _ = bags(b.column("text"))
        number = ragged(np.zeros(len(weights), np.int64), weights).astype(U64)
        elements = ((np.repeat(shingles, weights) << U64(16)) + (number & U64(65535))) ^ mix(number >> U64(16))  # mix(0) is 0
        at = np.concatenate([[0], np.cumsum(weights)])[offsets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.astype(np.int64)))], ["doc_id", "bag"])


def near_duplicates(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id, copy_of) of every row: the smallest doc_id of its group, and of the rows with the same words.

    Texts with the same words in the same order are copies; only the copy with
    the smallest id goes on, and copies never make pairs. Texts of one to four
    words have one shingle. A text without words is equal only to
    the same text; a null or empty text is in a group of its own. Rows that
    share a doc_id are one document; a null doc_id has a null group. No rows
    give no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = checkpointed(rows.mapInArrow(_sketches, "doc_id long, c1 long, c2 long, size long, bands array<long>"))
    classes = sketch.where("c1 is not null and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = checkpointed(classes)
    members = checkpointed(bucket_members(classes.where("size > 0").select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), "size")))
    wanted = members.select("id").distinct()
    bag = rows.join(wanted, rows.doc_id == wanted.id, "left_semi").mapInArrow(_bag_rows, "doc_id long, bag array<long>").dropDuplicates(["doc_id"])
    bag = checkpointed(bag)

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = bag.toDF("a", "bag_a"), bag.toDF("b", "bag_b")
        n, total = F.size(F.array_intersect("bag_a", "bag_b")), F.size("bag_a") + F.size("bag_b")
        return pairs.join(x, "a").join(y, "b").where(n >= (similarity - 1e-9) * (total - n)).select("a", "b")

    def most(ids: DataFrame) -> DataFrame:
        """What is left of a bag without the elements that none of the others has, and which of MARKS classes these elements are in."""
        own = bag.join(ids, bag.doc_id == ids.id).select("id", F.explode("bag").alias("element"))
        common = own.join(own.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("element"), "element")
        cell = F.pmod(F.xxhash64("element"), F.lit(MARKS))
        marks = [F.bit_or(F.when(F.floor(cell / 64) == j, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(element), {MARKS}) % 64 as int))")).otherwise(F.lit(0).cast("long"))) for j in range(MARKS // 64)]
        counted = common.groupBy("id").agg(F.count(F.lit(1)).alias("most"), F.array(*marks).alias("marks"))
        return ids.join(counted, "id", "left").select("id", F.coalesce("most", F.lit(0)).alias("most"), "marks")

    # a class that one bag has and the other lacks is an element at least that they don't share
    both = f"least(x.most - {lacking('x', 'y')}, y.most - {lacking('y', 'x')})"
    least = f"{(similarity - 1e-9) / (1 + similarity)}D * (x.size + y.size)"
    links = bucket_links(members, verify, f"least({{p}}, {{q}}) >= {similarity - 1e-9}D * greatest({{p}}, {{q}})", most, f"least(x.most, y.most) >= {least} and coalesce({both}, 0) >= {least}")
    groups = connected_components(links, "a", "b")
    reps = classes.select("c1", "c2", "rep")
    out = sketch.select("doc_id", "c1", "c2").join(reps, ["c1", "c2"], "left")
    out = out.select("doc_id", F.coalesce("rep", "doc_id").alias("copy_of"))
    out = out.join(groups, out.copy_of == groups.node, "left")
    return out.select("doc_id", F.coalesce("component", "copy_of").alias("group_id"), "copy_of")
