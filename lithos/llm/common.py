"""What several operators of this subpackage share: checkpoints, and numpy over Arrow's string buffers."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd base of the polynomial hashes, and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)
#: UTF-8 bytes that numpy handles at once; bounds the memory of a Python worker.
PIECE_BYTES = 4 << 20


#: Whether an execution's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL = threading.local()


def _tables() -> list[str]:
    """Tables that this thread has written to the shared folder, oldest first; `forget` deletes them. Those of a plan in another thread are not touched."""
    if not hasattr(_LOCAL, "tables"):
        _LOCAL.tables = []
    return _LOCAL.tables


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: computed once, its lineage cut, safe from lost executors.

    What the write has shuffled is deleted as it ends, so the disk in use is
    that of the largest step and not of all of them. The context's cleaner
    does not see to that: it waits until nobody holds `df`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _tables().append(path)
    gc.collect()
    spark._jvm.System.gc()  # and broadcasts of plans that nobody holds
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, at: int) -> None:
    """Delete the table number `at` of those written; nothing that still reads it may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables().pop(at))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written since there were `since` of them; nothing that still reads them may be used afterwards."""
    while written() > since:
        discard(spark, -1)


def written() -> int:
    return len(_tables())


def settled(df: DataFrame, since: int) -> DataFrame:
    """`df` checkpointed, and the tables it was made from, written since there were `since` of them, deleted: no other plan may need them."""
    out = checkpointed(df)
    while written() > since + 1:
        discard(df.sparkSession, since)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir` of the session.

    Where none is set, a local master gets a folder of its own; on a cluster
    that would lose data, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * _GOLD + U64(seed) * _M1)


_BYTE = seeded(256, 7)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE_BYTES + (PIECE_BYTES >> 2))
        for k, base in ((0, _BASE), (1, _INV)):
            out = np.ones(size, U64)
            out[1:] = U64(base)
            np.multiply.accumulate(out, out=out)
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of any byte range of `data`, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, k: int) -> np.ndarray:
        """Of each run of k bytes, by its start."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after another, and the n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows, in slices of at most `rows` rows whose `column` has about `limit` bytes or that have one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at] - sizes[at]
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross an offset."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (lower case; letters, digits, `_` and all beyond ASCII) of all rows, and the n+1 offsets of the rows in them."""
    data, offsets = flat(pc.utf8_lower(column))
    starts, ends = runs(_WORD[data], offsets)
    return Rolling(data).ranges(starts, ends), np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words inside each row, and the row offsets. A row of 1 to k-1 words has one shingle: all its words."""
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        step = seeded(k, 11) | U64(1)
        n = len(words)
        total = np.zeros(max(0, n - k + 1), U64)
        for j in range(k):
            total += words[j : n - k + 1 + j] * step[j]
        short = np.flatnonzero((counts > 0) & (counts < k))
        lengths = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        out_offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(out_offsets[-1], U64)
        long = counts >= k
        out[ragged(out_offsets[:-1][long], lengths[long])] = total[ragged(offsets[:-1][long], lengths[long])]
        for j in range(k - 1):
            some = short[counts[short] > j]
            out[out_offsets[some]] += words[offsets[some] + j] * step[j]
        return mix(out), out_offsets


def strings(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())
