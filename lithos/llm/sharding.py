"""Operator 6: sharding by a keyed Feistel permutation of global row numbers.

Row i of N goes to position P(i), P being a permutation of 0..N-1: a balanced
Feistel network over the next even number of bits, walked along its cycles
until it lands below N. Shard and slot are the remainder and the quotient of
the position by the number of shards, so anyone can compute them, or invert
them, from the row number and the key alone. Law: `rows`; counts of shards
differ by one at most and slots have no gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import U64, mix

#: Feistel rounds.
ROUNDS = 6
#: Hash buckets that row numbers are dealt in; their sizes, this many numbers, are all that comes to the driver.
BUCKETS = 4096


class Feistel:
    """A permutation of range(n) that depends on `key` only."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.rounds = n, rounds
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.keys = [int(x) for x in mix(np.array([(key * 1_000_003 + r * 0x9E3779B9) & (2**64 - 1) for r in range(rounds)], U64))]

    def _network(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        bits, mask = U64(self.half), U64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            if back:
                left, right = right ^ (mix(left ^ U64(k)) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ U64(k)) & mask)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._network(np.asarray(x, np.int64).astype(U64), keys, back)
        while len(far := np.flatnonzero(out >= U64(self.n))):
            out[far] = self._network(out[far], keys, back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def numbered(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """`rows` with a column row_number without gap from 0, and their number.

    The number depends on the values of `order` alone (rows equal in all of
    them are interchangeable): a hash of these deals the rows to `buckets`,
    whose sizes are summed up; inside a bucket a window counts. One shuffle,
    no sort of the whole, nothing unbounded on the driver.
    """
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dict(dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    counts = np.array([sizes.get(b, 0) for b in range(buckets)], np.int64)
    before = np.cumsum(counts) - counts
    offsets = F.broadcast(rows.sparkSession.createDataFrame(pd.DataFrame({"_bucket": np.arange(buckets, dtype=np.int32), "_before": before})))  # `buckets` rows
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    out = dealt.withColumn("_inside", inside).join(offsets, "_bucket").withColumn("row_number", F.col("_before") + F.col("_inside") - 1)
    return out.drop("_bucket", "_before", "_inside"), int(counts.sum())


def position(row_number: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, key).forward(x.to_numpy()))

    return permuted(row_number)


def shard(rows: DataFrame, order: list[str], shards: int, key: int = 0) -> DataFrame:
    """`rows` with row_number, shard and slot.

    Repeated rows count each. No rows give no rows; fewer rows than shards
    leave shards empty. Null values of `order` come first.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    out, n = numbered(rows, order)
    at = position(F.col("row_number"), n, key)
    out = out.withColumn("_position", at)
    return out.withColumn("shard", F.pmod("_position", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"_position div {shards}")).drop("_position")
