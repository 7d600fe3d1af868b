"""k-means per group without a group in one task (V9, V10; used by V11, J8).

Tokens are dealt once to blocks of about ``BLOCK`` rows, written as one row
a block. In each Lloyd round the centres of a group (``k`` rows, one array) are
joined to its blocks; a block returns sizes and vector sums per cluster, and
Spark adds them up per (group, cluster). So a hot group is spread over as many
tasks as it has blocks, and what moves in a round is centres and sums only.

Rules (those of the in-task kernels, which the tests compare): the first centres are the rows
of least seeded uniform; the nearest centre is the least ``|c|^2 / 2 - x.c``,
the smaller number on ties; an empty centre stays; a round that moves no
centre by ``atol`` is not taken. Groups with fewer tokens than ``k`` have as many centres
as tokens; a null vector takes no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import uniform
from ..session import written
from .groupwise import group_top
from .kernels import farthest_first, nearest_centre

BLOCK = 1024
# Rounds and tolerances of the reference's Lloyd steps.
MAX_ITERS, ATOL, RTOL = 10, 1e-4, 1e-5


def _blocks(df: DataFrame, keys) -> DataFrame:
    """(keys, ids, vecs): a row for each block, tokens in order."""
    d = df.where(F.col("vec").isNotNull()).select(*keys, F.col("token_idx").cast("bigint").alias("token_idx"), "vec")
    sizes = d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_n"))
    dealt = d.join(sizes, keys).withColumn("_b", F.pmod(F.xxhash64("token_idx"), F.col("_n")).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("token_idx", "vec")))
    packed = dealt.groupBy(*keys, "_b").agg(rows.alias("_r"))
    return written(packed.select(*keys, F.col("_r.token_idx").alias("ids"), F.col("_r.vec").alias("vecs")), "token-blocks")


def _centre_rows(rows: DataFrame, keys, order: str, vec: str) -> DataFrame:
    """(keys, centres): one array a group, in the order of ``order``; ``k`` rows at most."""
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vec).alias("v")))).alias("_c"))
    return packed.select(*keys, F.col("_c.v").alias("centres"))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for vecs in batch.column(column):
        flat = vecs.values
        yield flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _over_blocks(blocks: DataFrame, centres: DataFrame, keys, fn, out: str, kinds) -> DataFrame:
    """``fn(ids, vectors, centres)`` -> columns of ``out`` for every block."""
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (ids, x, c) in enumerate(zip(batch.column("ids"), _matrices(batch, "vecs"), _matrices(batch, "centres"))):
                cols = fn(ids.values.to_numpy(), x, c)
                head = [pa.array([batch.column(k)[i].as_py()] * len(cols[0]), batch.schema.field(k).type) for k in keys]
                yield pa.record_batch(head + [pa.array(v, kind) for v, kind in zip(cols, kinds)], [*keys, *names])

    joined = blocks.join(centres, list(keys)).select(*keys, "ids", "vecs", "centres")
    return joined.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + out)


def _moved(blocks: DataFrame, centres: DataFrame, keys) -> DataFrame:
    """The centres after one round, and whether any of the group moved."""
    def sums(ids, x, c):
        own = nearest_centre(x, c)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros(c.shape)
        np.add.at(total, own, x)
        has = np.flatnonzero(size)
        return has, size[has], list(total[has])

    parts = _over_blocks(blocks, centres, keys, sums, "cluster int, n bigint, total array<double>",
                         (pa.int32(), pa.int64(), pa.list_(pa.float64())))
    # sums by component; a row a component, then k rows a group
    per = parts.select(*keys, "cluster", "n", F.posexplode("total").alias("_p", "_x")).groupBy(*keys, "cluster", "_p") \
        .agg((F.sum("_x") / F.sum("n")).alias("_m"))
    means = per.groupBy(*keys, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("vec"))
    packed = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "vec"))).alias("_means"))
    j = centres.join(packed, list(keys))
    new = F.transform("centres", lambda c, i: F.coalesce(F.element_at("_means", i.cast("int")), c))
    far = lambda a, b: F.abs(a - b) > F.lit(ATOL) + F.lit(RTOL) * F.abs(b)
    changed = F.exists(F.zip_with("centres", "_new", lambda a, b: F.exists(F.zip_with(a, b, far), lambda x: x)), lambda x: x)
    j = j.withColumn("_new", new).withColumn("moved", changed)
    return j.select(*keys, F.when(F.col("moved"), F.col("_new")).otherwise(F.col("centres")).alias("centres"), "moved")


def lloyd(df: DataFrame, keys, k: int, seed: int = 42, max_iters: int = MAX_ITERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, centres of the last assignment, last centres) of every group."""
    keys = list(keys)
    blocks = _blocks(df, keys)
    u = uniform(seed, *[F.col(c) for c in keys], F.col("token_idx"))
    first = group_top(df.where(F.col("vec").isNotNull()).withColumn("_u", u), keys, [F.asc("_u"), F.asc("token_idx")], "_r", k, 0)
    now = written(_centre_rows(first, keys, "_r", "vec"), "centres")
    before = now
    for _ in range(max_iters):
        step = written(_moved(blocks, now, keys), "centres")
        before, now = now, step.select(*keys, "centres")
        if step.where("moved").isEmpty():
            break
    return blocks, before, now


def _assigned(blocks: DataFrame, centres: DataFrame, keys) -> DataFrame:
    return _over_blocks(blocks, centres, keys, lambda ids, x, c: (ids, nearest_centre(x, c)), "token_idx bigint, cluster int",
                        (pa.int64(), pa.int32()))


def kmeans_assign(df: DataFrame, keys, k: int, seed: int = 42) -> DataFrame:
    """V10 per group: (keys, token_idx, cluster) after <= 10 Lloyd steps."""
    blocks, before, _ = lloyd(df, keys, k, seed)
    return _assigned(blocks, before, list(keys))


def cluster_select(df: DataFrame, keys, k: int, seed: int = 42) -> DataFrame:
    """V9 per group: ``2k`` clusters, their centres taken farthest-first from the one
    nearest the mean of the group, each stood for by its own nearest token."""
    keys = list(keys)
    blocks, before, last = lloyd(df, keys, 2 * k, seed)
    # both sets of centres side by side: k numbers are matched by the first, gaps measured to the second
    both = before.join(last.withColumnRenamed("centres", "_last"), keys).select(*keys, F.concat("centres", "_last").alias("centres"))

    def gaps(ids, x, c):
        half = len(c) // 2
        own = nearest_centre(x, c[:half])
        return ids, own, ((x - c[half:][own]) ** 2).sum(axis=1)

    spread = _over_blocks(blocks, both, keys, gaps, "token_idx bigint, cluster int, gap double", (pa.int64(), pa.int32(), pa.float64()))
    nearest = spread.groupBy(*keys, "cluster").agg(F.min_by("token_idx", F.struct("gap", "token_idx")).alias("token_idx"))
    ex = df.where(F.col("vec").isNotNull()).select(*keys, F.posexplode("vec").alias("_p", "_x"))
    mean = ex.groupBy(*keys, "_p").agg(F.avg("_x").alias("_m")).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("mean"))
    types = {f.name: f.dataType.simpleString() for f in last.schema.fields}

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """2k centres a group, in farthest-first order."""
        for batch in batches:
            for i, (c, mean) in enumerate(zip(_matrices(batch, "centres"), batch.column("mean"))):
                m = np.array(mean.as_py())
                chosen = farthest_first(c, k, int(((c - m) ** 2).sum(axis=1).argmin()))
                head = [pa.array([batch.column(key)[i].as_py()] * len(chosen), batch.schema.field(key).type) for key in keys]
                yield pa.record_batch(head + [pa.array(chosen, pa.int32()), pa.array(np.arange(len(chosen)), pa.int32())], [*keys, "cluster", "_o"])

    chosen = last.join(mean, keys).select(*keys, "centres", "mean").mapInArrow(
        order, ", ".join(f"{key} {types[key]}" for key in keys) + ", cluster int, _o int")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o")) - 1  # k rows a group
    return chosen.join(nearest, [*keys, "cluster"]).select(*keys, "token_idx", rank.cast("int").alias("pick_rank"))
