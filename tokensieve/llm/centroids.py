"""Centroid clustering: k-means in integers, with a vantage-point tree over the centroids.

Each vector is scaled to integers once and written to the shared folder. In
every round the tree is built anew from the centroids on the driver (``k``
rows) and broadcast; a vector is assigned by a best-first branch-and-bound of
its own: of its open nodes the one of the least lower bound is taken next,
until none has a bound within the best distance found. The bound is inclusive, with
room for rounding, so that a centroid at the same distance is still met and
the smaller number wins. Distances that decide are sums of squares in 64-bit integers.
Tasks send one row of sums for each centroid, which Spark adds up; the new
centroids are exact floors of sum by count.

Defined results: a vector is kept if it has ``dims`` components, none null,
non-finite or, scaled, beyond 2^27 in size (its squared distance would not fit
64 bits; such a vector counts as non-finite). Repeated rows count and come back
as often as they are there; where ids, and so their hashes, are equal the
smaller components come first; a null id hashes as an empty one. Fewer than
``k`` kept vectors give that many centroids; none, or an empty table, no rows.
Centroids that are equal leave all vectors to the smallest number, and the
empty ones stay. Only ``vec_id`` and ``embedding`` are read, whatever other columns hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LIMIT = 1 << 27
#: Vectors searched together; bounds the memory of a task.
TOGETHER = 2048


class VantageTree:
    """Centroids in a binary tree: a node has a vantage point, and of each of its
    two halves the least and the greatest distance to that point."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.point: list[int] = []
        self.child: list[list[int]] = []
        self.near: list[list[float]] = []
        self.far: list[list[float]] = []
        if len(centroids):
            self._grow(np.arange(len(centroids)))

    def _grow(self, members: np.ndarray) -> int:
        """The node over ``members``, whose vantage point is the one farthest from their middle."""
        node, own = len(self.point), self.centroids[members]
        at = int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())
        self.point.append(int(members[at]))
        self.child.append([-1, -1]), self.near.append([0.0, 0.0]), self.far.append([0.0, 0.0])
        rest = np.delete(members, at)
        if len(rest):
            gap = np.sqrt(squares(self.centroids[rest], self.centroids[members[at]]).astype(float))
            order = np.argsort(gap, kind="stable")
            for side, half in enumerate(np.array_split(order, 2)):
                if len(half):
                    self.near[node][side], self.far[node][side] = gap[half].min(), gap[half].max()
                    self.child[node][side] = self._grow(rest[half])
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid.

        The rows search side by side, each with its own open nodes and bounds.
        """
        best = np.full(len(x), np.iinfo(np.int64).max)
        found = np.zeros(len(x), np.int64)
        bound = np.full((len(x), len(self.point)), np.inf)
        bound[:, 0] = 0.0
        active = np.arange(len(x))
        while len(active):
            node = bound[active].argmin(axis=1)
            radius = np.sqrt(best[active].astype(float))
            open_ = bound[active, node] <= radius * (1 + 1e-9) + 1e-6
            active, node = active[open_], node[open_]
            for n in np.unique(node):
                rows = active[node == n]
                c = self.point[n]
                d = squares(x[rows], self.centroids[c])
                better = (d < best[rows]) | (d == best[rows]) & (c < found[rows])
                best[rows[better]], found[rows[better]] = d[better], c
                gap = np.sqrt(d.astype(float))
                for side, child in enumerate(self.child[n]):
                    if child >= 0:
                        least = np.maximum(gap - self.far[n][side], self.near[n][side] - gap)
                        bound[rows, child] = np.maximum(bound[rows, n], least)
                bound[rows, n] = np.inf
        return found, best


def squares(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return np.einsum("ij,ij->i", d, d)


def scaled(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """id and the integer components ``q`` of the vectors kept."""
    q = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    fits = (F.size("embedding") == dims) & F.forall(
        "embedding", lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * scale < LIMIT), F.lit(False)))
    return vectors.select(F.col("vec_id").alias("vec_id"), "embedding").where(F.coalesce(fits, F.lit(False))).select("vec_id", q.alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<vec_id>``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()  # k rows, a parameter
    return np.array([r.q for r in rows], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _searched(kept: DataFrame, centroids: np.ndarray):
    """The broadcast tree, and what assigns a batch's column ``q`` to it."""
    tree = kept.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    dims = centroids.shape[1]

    def assign(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x = _matrix(column, dims)
        for at in range(0, len(x), TOGETHER):
            yield x[at:at + TOGETHER], *tree.value.nearest(x[at:at + TOGETHER])

    return assign


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: exact floors of the means; a centroid without vectors stays."""
    assign, shape = _searched(kept, centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for batch in batches:
            for x, own, _ in assign(batch.column(0)):
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=shape[0])
        has = np.flatnonzero(count)
        yield pa.record_batch([pa.array(has.astype(np.int32)), pa.array(count[has]), pa.array(list(total[has]), pa.list_(pa.int64()))],
                              ["cluster", "n", "total"])

    parts = kept.select("q").mapInArrow(run, "cluster int, n long, total array<long>")
    # k rows of sums, whatever the number of vectors
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(shape[1])))
    after = centroids.copy()
    for cluster, n, *total in sums.collect():
        after[cluster] = [s // n for s in total]
    return after


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept."""
    kept = written(scaled(vectors, dims, scale), "scaled-vectors")
    centroids = first_centroids(kept, k, seed)
    kinds = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], f"{kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    assign = _searched(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, own, distance in assign(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(x)), pa.array(own.astype(np.int32)), pa.array(distance)],
                                      ["vec_id", "cluster", "distance"])
                at += len(x)

    rows = written(kept.select("vec_id", "q").mapInArrow(run, kinds), "assigned-vectors")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    inertia = sum(r.cluster_inertia for r in per)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = kept.sparkSession.createDataFrame(
        [(r.cluster, r.cluster_inertia, inertia, sha[r.cluster]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """DuckDB text of ``cluster`` over ``embeddings``."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, q FROM (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c) OR abs(CAST(c AS DOUBLE)) * {scale} >= {LIMIT})) = 0))""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS cluster, q
  FROM v ORDER BY cluster LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT row, vec_id, min((d, cluster)) AS best FROM (
  SELECT v.row, v.vec_id, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS d
  FROM v CROSS JOIN c{r} c) GROUP BY row, vec_id)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
    SELECT a.best[2] AS cluster, g.i, CAST(sum(v.q[g.i]) AS BIGINT) AS s, count(*) AS n
    FROM a{r} a JOIN v USING (row) CROSS JOIN (SELECT unnest(range(1, {dims + 1})) AS i) g GROUP BY 1, 2) GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, CAST(a.best[1] AS BIGINT) AS distance,
  CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best[2]"""


SQL = sql()
