"""Size-aware per-group ranking and statistics.

Small groups (the common case: an image has hundreds of tokens) use one
window per group: a single hash shuffle on the key, reused by later
windows.  When the largest group exceeds ``max_group`` rows, the same
results come from plans that spread a hot group over many tasks:

* rank inside a group = global row number over (keys, order) minus the
  group's first number; the global numbering range-partitions on the full
  sort key, so one group's rows land in many partitions;
* group statistics stay unordered windows (see ``group_stats``).

Both give the same ranks (tested). The caller passes ``largest`` (a size bound
known on the driver), so the choice is made at plan time; numbering writes its
range-partitioned input to the shared folder once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number_rows

MAX_GROUP = 20_000


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def _limit(max_group):
    return MAX_GROUP if max_group is None else max_group


def group_rank(df: DataFrame, keys, order: list, out: str, largest: int | None = None,
               max_group: int | None = None) -> DataFrame:
    """0-based position of each row inside its group in ``order`` (a list
    of sort Columns ending in a unique tie-break)."""
    ks = _keys(keys)
    if largest is not None and largest <= _limit(max_group):
        w = Window.partitionBy(*ks).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    sort_cols = [F.col(k).asc() for k in ks] + list(order)
    numbered = number_rows(df, sort_cols, "_g")
    first = numbered.groupBy(*ks).agg(F.min("_g").alias("_g0"))
    return numbered.join(first, ks).withColumn(out, (F.col("_g") - F.col("_g0")).cast("int")).drop("_g", "_g0")


def group_top(df: DataFrame, keys, order: list, out: str, k, largest: int | None = None,
              max_group: int | None = None) -> DataFrame:
    """Rows whose ``group_rank`` is below ``k`` (a number, or a column's name).

    A number is compared with ``row_number()`` itself, so that Spark cuts each
    group before the shuffle (WindowGroupLimit)."""
    if isinstance(k, int) and largest is not None and largest <= _limit(max_group):
        w = Window.partitionBy(*_keys(keys)).orderBy(*order)
        top = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
        return top.withColumn(out, (F.col(out) - 1).cast("int"))
    ranked = group_rank(df, keys, order, out, largest, max_group)
    return ranked.where(F.col(out) < (F.lit(k) if isinstance(k, int) else F.col(k)))


def group_stats(df: DataFrame, keys, largest: int | None = None, max_group: int | None = None,
                **aggs: Column) -> DataFrame:
    """Attach per-group aggregates ``name=expr`` to every row.

    Always an unordered window: the aggregate-and-join-back form doubles the
    upstream plan at every chained use (exponential growth in the
    multi-softmax pipelines), so it is not used here (open item: a
    materialised statistics table for groups above ``max_group``)."""
    ks = _keys(keys)
    w = Window.partitionBy(*ks)
    return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])


def group_softmax(df: DataFrame, keys, col: str, out: str, largest: int | None = None,
                  max_group: int | None = None) -> DataFrame:
    m = group_stats(df, keys, largest, max_group, _mx=F.max(col))
    e = m.withColumn("_e", F.exp(F.col(col) - F.col("_mx")))
    s = group_stats(e, keys, largest, max_group, _se=F.sum("_e"))
    return s.withColumn(out, F.col("_e") / F.col("_se")).drop("_mx", "_e", "_se")

