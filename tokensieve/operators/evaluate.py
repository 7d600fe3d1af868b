"""Evaluation joins, filters and summaries.

All of it is relational: one ``groupBy`` (map-side partial aggregation
before the shuffle) per summary, equi-joins on keys, and parameter tables
expanded with ``explode`` instead of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import TOKENS_PER_IMAGE
from .numbering import number_rows

# A configuration grid is a parameter table; above this size it is not a
# grid any more and must be joined, not inlined into the plan.
MAX_INLINE_CONFIGS = 10_000


def _round(c: Column, dp: int = 6) -> Column:
    return F.round(c, dp)


# J1
def config_sweep(items: DataFrame, configs: DataFrame) -> DataFrame:
    """Every item under every configuration.

    The grid is a small parameter table: its size is checked, then it is
    inlined as a literal array and exploded next to each item (a Generate
    in the same stage, no join and no shuffle).
    """
    rows = configs.limit(MAX_INLINE_CONFIGS + 1).collect()
    if len(rows) > MAX_INLINE_CONFIGS:
        raise ValueError(f"configuration grid has more than {MAX_INLINE_CONFIGS} rows; join it instead")
    fields = configs.schema.fields
    structs = [
        F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in rows
    ]
    cfg = F.explode(F.array(*structs)) if structs else F.explode(F.array().cast(
        "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields) + ">>"))
    return items.select("*", cfg.alias("_cfg")).select(
        *[F.col(c) for c in items.columns], *[F.col("_cfg." + f.name).alias(f.name) for f in fields]
    )


# J2
def cache_lookup(questions: DataFrame, pruned: DataFrame, keys=("config_id", "image_id")) -> DataFrame:
    """Each question gets its image's pruned result (many-to-one equi-join)."""
    return questions.join(pruned, list(keys), "inner")


# J3 / P5
def failed_group_report(all_groups: DataFrame, cached: DataFrame, keys) -> DataFrame:
    return all_groups.join(cached, list(keys), "left_anti")


def skip_failed_groups(rows: DataFrame, cached: DataFrame, keys) -> DataFrame:
    return rows.join(cached.select(*keys).distinct(), list(keys), "left_semi")


# J5
def response_join(items: DataFrame, responses: DataFrame, key: str = "question_id") -> DataFrame:
    """Item with its response; no response -> ``api_success`` false."""
    r = responses.withColumn("_has_response", F.lit(True))
    out = items.join(r, key, "left")
    return out.withColumn("api_success", F.coalesce(F.col("_has_response"), F.lit(False))).drop("_has_response")


# P1 / P2 / P3
def successful_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("api_success"))


def successful_with_prediction(df: DataFrame) -> DataFrame:
    return df.where(F.col("api_success") & (F.col("predicted_answer") != ""))


def non_empty_questions(df: DataFrame, col: str = "question") -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.length(col) > 0))


# A7
def config_summary(results: DataFrame, keys=("keep_ratio", "recovery_ratio"),
                   n_tokens: int = TOKENS_PER_IMAGE) -> DataFrame:
    """Per configuration: n, successes, correct, accuracy, mean times over
    successes, mean output tokens and token reduction."""
    ok = F.col("api_success")
    avg_ok = lambda c: F.avg(F.when(ok, F.col(c)))
    g = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_success"),
        F.count_if(ok & F.col("is_correct")).alias("n_correct"),
        avg_ok("embed_time").alias("avg_embed_time"),
        avg_ok("api_call_time").alias("avg_api_time"),
        avg_ok("pruned_token").alias("avg_pruned_tokens"),
    )
    return g.select(
        *keys, "n", "n_success", "n_correct",
        _round(F.col("n_correct") / F.nullif(F.col("n_success"), F.lit(0))).alias("accuracy"),
        _round(F.col("avg_embed_time")).alias("avg_embed_time"),
        _round(F.col("avg_api_time")).alias("avg_api_time"),
        _round(F.col("avg_pruned_tokens")).alias("avg_pruned_tokens"),
        _round(T.token_reduction_pct(F.col("avg_pruned_tokens"), n_tokens)).alias("token_reduction_pct"),
    )


# A9
def summary_by_ratio_key(results: DataFrame, n_tokens: int = TOKENS_PER_IMAGE) -> DataFrame:
    """Successes grouped by the key string ``keep_<k>_recovery_<r>``."""
    key = F.concat(F.lit("keep_"), F.col("keep_ratio").cast("string"), F.lit("_recovery_"),
                   F.col("recovery_ratio").cast("string"))
    s = successful_only(results).groupBy(key.alias("config_key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_correct")).alias("n_correct"),
        F.avg("embed_time").alias("e"), F.avg("api_call_time").alias("a"), F.avg("pruned_token").alias("p"),
    )
    return s.select(
        "config_key", "n", "n_correct", _round(F.col("n_correct") / F.col("n")).alias("accuracy"),
        _round(F.col("e")).alias("avg_embed_time"), _round(F.col("a")).alias("avg_api_time"),
        _round(F.col("p")).alias("avg_pruned_tokens"),
        _round(T.token_reduction_pct(F.col("p"), n_tokens)).alias("token_reduction_pct"),
    )


# A7 + A15 in one pass
def config_rollup(results: DataFrame) -> DataFrame:
    """Per-configuration and overall counts in one aggregation (rollup)."""
    ok = F.col("api_success")
    r = results.rollup("keep_ratio", "recovery_ratio").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_success"),
        F.count_if(ok & F.col("is_correct")).alias("n_correct"),
    )
    return r.select("keep_ratio", "recovery_ratio", F.col("level").cast("int").alias("level"), "n",
                    "n_success", "n_correct",
                    _round(F.col("n_success") / F.col("n")).alias("success_rate"))


# A11
def timing_summary(results: DataFrame, cols=("embed_time", "api_call_time", "total_time")) -> DataFrame:
    """sum / mean / min / max / sample std of each time over successes, one row per metric."""
    ok = successful_only(results)
    aggs = []
    for c in cols:
        aggs += [F.sum(c).alias(f"{c}__sum"), F.avg(c).alias(f"{c}__mean"), F.min(c).alias(f"{c}__min"),
                 F.max(c).alias(f"{c}__max"), F.stddev_samp(c).alias(f"{c}__std")]
    wide = ok.agg(*aggs)
    stack = ", ".join(
        f"'{c}', `{c}__sum`, `{c}__mean`, `{c}__min`, `{c}__max`, `{c}__std`" for c in cols
    )
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) as (metric, total, mean, min, max, std)")
    return long.select("metric", *[_round(F.col(c)).alias(c) for c in ("total", "mean", "min", "max", "std")])


# A14
SUMMARY_TIMES = {"project_time": "project_time", "preprocess_time": "preprocess_time", "encode_time": "encode_time", "prune_time": "prune_time",
                 "embed_time": "embed_time", "api_call_time": "api_time", "total_time": "total_time"}


def summary_min_max_avg(results: DataFrame) -> DataFrame:
    """Mean, minimum and maximum of every time that ``results`` has, the sum of the
    total and the mean output tokens, over successes; one row, one pass."""
    ok = successful_only(results)
    aggs = []
    for c, short in SUMMARY_TIMES.items():
        if c in results.columns:
            aggs += [_round(F.avg(c)).alias(f"avg_{short}"), _round(F.min(c)).alias(f"min_{short}"), _round(F.max(c)).alias(f"max_{short}")]
    return ok.agg(*aggs, _round(F.sum("total_time")).alias("sum_total_time"), _round(F.avg("pruned_token")).alias("avg_tokens"))


# A12
def accuracy_nonempty(results: DataFrame) -> DataFrame:
    s = successful_with_prediction(results)
    return s.agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if(F.col("is_correct")).alias("n_correct"),
    ).select("n_predictions", "n_correct",
             _round(F.coalesce(F.col("n_correct") / F.nullif(F.col("n_predictions"), F.lit(0)) * 100,
                               F.lit(0.0))).alias("accuracy_pct"))


# A15
def overall_statistics(results: DataFrame, items_key: str, config_key=("keep_ratio", "recovery_ratio")) -> DataFrame:
    ok = F.col("api_success")
    return results.agg(
        F.count_distinct(F.col(items_key)).alias("n_items"),
        F.count_distinct(*[F.col(c) for c in config_key]).alias("n_configs"),
        F.count(F.lit(1)).alias("n_evaluations"),
        F.count_if(ok).alias("n_success"),
    ).select("*", _round(F.col("n_success") / F.col("n_evaluations")).alias("success_rate"))


# A1 / A2 / A3 / A5
def group_questions(questions: DataFrame, key: str, order: str, text: str = "question",
                    payload: str | None = None) -> DataFrame:
    """Per group: question count, ordered combined guidance text, first payload.

    ``string_agg`` keeps the in-group order explicit; ``min_by`` picks the
    first payload deterministically (never ``first()``).
    """
    q = non_empty_questions(questions, text)
    aggs = [
        F.count(F.lit(1)).alias("questions_used_for_pruning"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
                        lambda x: x["t"]),
            " ",
        ).alias("combined_guidance"),
    ]
    if payload is not None:
        aggs.append(F.min_by(F.col(payload), F.col(order)).alias("first_payload"))
    return q.groupBy(key).agg(*aggs)


# A4
def group_sizes_top(questions: DataFrame, key: str, n: int = 10) -> DataFrame:
    return questions.groupBy(key).agg(F.count(F.lit(1)).alias("n_questions")) \
        .orderBy(F.desc("n_questions"), F.asc(key)).limit(n)


# A6
def amortised_cost(rows: DataFrame, group_keys, cost: str) -> DataFrame:
    """Group cost shared evenly over the group's rows.

    Group sizes come from a partial aggregate joined back, not from a
    window, so a hot group is never sorted inside one task."""
    sizes = rows.groupBy(*group_keys).agg(F.count(F.lit(1)).alias("_group_rows"))
    out = rows.join(sizes, list(group_keys), "inner")
    return out.withColumn(f"amortised_{cost}", F.col(cost) / F.col("_group_rows")).drop("_group_rows")


# A16
def extraction_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# W17
def global_row_number(df: DataFrame, order_col, name: str = "row_number") -> DataFrame:
    """1-based row number over a unique sort key (see ``number_rows``)."""
    keys = [order_col] if isinstance(order_col, str) else list(order_col)
    return number_rows(df, keys, name)
