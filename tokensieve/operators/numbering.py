"""Row numbers and running sums, over a whole table or inside groups, without
a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def number_rows(df: DataFrame, sort_cols: list, name: str) -> DataFrame:
    """1-based number of each row in the order of ``sort_cols`` (ending in a
    unique tie-break).

    Rows are range-partitioned and written together with their partition id.
    The table is read twice, to number the rows of each partition and to sum
    the partitions before it; both readings see the same ids, however the two
    plans are pruned, sampled or coalesced.
    """
    ranged = written(df.repartitionByRange(*sort_cols).withColumn("_pid", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_ln", F.row_number().over(Window.partitionBy("_pid").orderBy(*sort_cols)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_pid").alias("_opid"), F.coalesce(before, F.lit(0)).alias("_off"))
    out = local.join(F.broadcast(offsets), F.col("_pid") == F.col("_opid"))
    return out.select(*df.columns, (F.col("_off") + F.col("_ln")).cast("bigint").alias(name))


def number_in_groups(df: DataFrame, keys: list[str], sort_cols: list, value: str, pos: str, total: str) -> DataFrame:
    """0-based position of each row in its group in the order of ``sort_cols``
    (ending in a unique tie-break), and the running sum of ``value`` up to it.

    Rows are range-partitioned by group and order and written with their partition
    id, so a group of any size lies in as many partitions as it needs. Each
    partition numbers and adds up its own rows; what the partitions before it
    hold of the same group is added as one offset.
    """
    order = [F.col(k).asc() for k in keys] + list(sort_cols)
    ranged = written(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("_pid", *keys).orderBy(*sort_cols)
    local = ranged.withColumn("_ln", F.row_number().over(own) - 1) \
        .withColumn("_ls", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = parts.select(F.col("_pid").alias("_opid"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_os"))
    same = F.col("_pid") == F.col("_opid")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return local.join(offsets, same).select(*df.columns, (F.col("_on") + F.col("_ln")).cast("bigint").alias(pos), (F.col("_os") + F.col("_ls")).alias(total))
