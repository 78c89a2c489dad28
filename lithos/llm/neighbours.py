"""Operator 3: nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and every vector is indexed: its leaf
in each tree is computed where it lies. A query walks all trees through one
priority queue, whose order is the least margin by which a branch was missed,
and takes leaves until they hold its share of candidates. Leaves and the
queries that visit them meet in buckets, where exact distances give each
query its nearest of a leaf; the nearest of all leaves are the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import checkpointed

#: Vectors that the trees are fitted on, at most about (chosen by a hash of the id).
SAMPLE = 20_000
TREES = 8
#: Vectors of a leaf, about, and the share of all vectors that a query looks at with the least number of them.
LEAF, SHARE, LEAST = 64, 0.65, 2_000
#: Vectors of a bucket of leaves, about.
BUCKET = 20_000


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: a vector goes left if normal . x < cut; a child below 0 is the leaf ~child."""

    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: tuple[int, ...]
    sizes: np.ndarray  # sample vectors of each leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf of each vector."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while len(on := np.flatnonzero(node >= 0)):
                at = node[on]
                side = np.einsum("ij,ij->i", x[on], self.normal[at]) < self.cut[at]
                node[on] = np.where(side, self.left[at], self.right[at])
            out[:, t] = ~node
        return out

    def visit(self, x: np.ndarray, wanted: float) -> list[int]:
        """Leaves of one query, nearest branch first, until they have `wanted` sample vectors."""
        side = self.normal @ x - self.cut
        heap = [(-np.inf, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(heap)
        out, count = [], 0
        while heap and count < wanted:
            miss, t, node = heapq.heappop(heap)
            while node >= 0:
                s = side[node]
                near, far = (self.left[node], self.right[node]) if s < 0 else (self.right[node], self.left[node])
                heapq.heappush(heap, (max(miss, abs(s)), t, int(far)))
                node = int(near)
            out.append(~node)
            count += self.sizes[~node]
        return out


def fit(sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = 5) -> Forest:
    """Halve by the projection on a random direction, at the median, down to `leaf` vectors; equal projections stay together."""
    rng = np.random.default_rng(seed)
    normal, cut, left, right, sizes, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(3):
                direction = rng.standard_normal(sample.shape[1])
                direction /= np.linalg.norm(direction)
                at = sample[rows] @ direction
                value = np.median(at)
                side = at < value
                if side.any():
                    n = len(normal)
                    normal.append(direction), cut.append(value), left.append(0), right.append(0)
                    left[n], right[n] = grow(rows[side]), grow(rows[~side])
                    return n
        sizes.append(max(1, len(rows)))
        return ~(len(sizes) - 1)

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
    width = sample.shape[1]
    return Forest(np.array(normal).reshape(-1, width), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), tuple(roots), np.array(sizes))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, key: str, vector: str, queries: str, k: int = 10, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that the condition `queries` (on `key`) takes.

    Score is the Euclidean distance in double precision; ties go to the
    smaller id, and a query is not its own neighbour. Null vectors, those of
    zeros only, those with a null or non-finite component and rows with a null
    id take no part; a row repeated with the same id counts once. Vectors must
    have one length. Of equal vectors only the k+1 smallest ids are indexed,
    which is all that any query can use, and equal queries search once, so
    a vector that a third of all rows share makes no large leaf.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"))
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    base = checkpointed(distinct)
    n = base.count()
    asked = rows.where(queries.replace(key, "vec_id")).distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    part = min(1.0, sample / n)
    chosen = base.where((F.xxhash64("vec_id", F.lit("forest")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < part).orderBy("vec_id").limit(2 * sample)
    points = _matrix(pa.Table.from_batches(chosen.select("v").toArrow().to_batches()).column("v")) if n else np.zeros((0, 1))
    if not len(points):
        points = _matrix(base.orderBy("vec_id").limit(1).select("v").toArrow().column("v"))
    forest = fit(points, max(8, round(LEAF * len(points) / n)), trees)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # nodes: 2 x trees x sample / 8 at most
    wanted = max(least, share * n) * len(points) / n
    buckets = int(n * trees // BUCKET + 12)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = shared.value.leaves(_matrix(b.column("v")))
            row = np.repeat(np.arange(len(leaves)), leaves.shape[1])
            leaf = leaves.ravel()
            yield pa.RecordBatch.from_arrays([pa.array((leaf % buckets).astype(np.int32)), pa.array(leaf), b.column("vec_id").take(pa.array(row)), b.column("v").take(pa.array(row))], ["bucket", "leaf", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(_matrix(b.column("v"))):
                leaf = np.array(shared.value.visit(x, wanted))
                own = leaf % buckets
                for bucket in np.unique(own):
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int32()), b.column("asker").slice(i, 1), b.column("v").slice(i, 1), pa.array([leaf[own == bucket]], pa.list_(pa.int64()))], ["bucket", "asker", "v", "leaves"])

    def search(key: tuple, askers: pa.Table, members: pa.Table) -> pa.Table:
        out = []
        if len(askers) and len(members):
            x, ids, leaf = _matrix(members.column("v")), members.column("vec_id").to_numpy(), members.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            x, ids, leaf = x[order], ids[order], leaf[order]
            visits = askers.column("leaves").combine_chunks()
            of = np.repeat(np.arange(len(askers)), np.diff(visits.offsets.to_numpy()))
            visited = visits.flatten().to_numpy()
            q, names = _matrix(askers.column("v")), askers.column("asker").to_numpy()
            for at in np.argsort(of, kind="stable"):
                a, b = np.searchsorted(leaf, visited[at]), np.searchsorted(leaf, visited[at], "right")
                if a == b:
                    continue
                d = np.sqrt(((x[a:b] - q[of[at]]) ** 2).sum(1))
                top = np.lexsort((ids[a:b], d))[: k + 1]
                out.append((np.full(len(top), names[of[at]]), ids[a:b][top], d[top]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found = pd.DataFrame({"asker": a, "vec_id": b, "score": c}).drop_duplicates(["asker", "vec_id"]).sort_values(["asker", "score", "vec_id"]).groupby("asker").head(k + 1)
        return pa.Table.from_pandas(found, preserve_index=False)

    # equal queries: the one with the smallest id asks for all
    asker = asked.join(asked.groupBy("v").agg(F.min("vec_id").alias("asker")), "v")
    members = base.select("vec_id", "v").mapInArrow(index, "bucket int, leaf long, vec_id long, v array<double>")
    probes = asked.groupBy("v").agg(F.min("vec_id").alias("asker")).select("asker", "v").mapInArrow(probe, "bucket int, asker long, v array<double>, leaves array<long>")
    found = probes.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(search, "asker long, vec_id long, score double").distinct()
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    lists = best.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k+1 each
    each = asker.select(F.col("vec_id").alias("query_id"), "asker").join(lists, "asker")
    near = F.expr(f"slice(filter(near, x -> x.vec_id != query_id), 1, {k})")
    return each.select("query_id", F.posexplode(near).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
