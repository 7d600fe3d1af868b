"""Registered queries: evaluation joins, parsing and summaries over the
canonical views.  Every query has a DuckDB twin in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..sources import tables as tb
from .sqlbits import EVAL_RESULTS, budget, duckdb_with, mc_parse, strip, trunc_int, yes_no

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def eval_results(spark: SparkSession, sf: str) -> DataFrame:
    """eval_log with parsed prediction, correctness, output tokens, total time."""
    e = tb.eval_log(spark, sf)
    pred = T.parse_mc_answer(F.col("generated_text"))
    return e.select(
        "*",
        T.token_budget("keep_ratio", "recovery_ratio")["output"].alias("pruned_token"),
        T.total_time("embed_time", "api_call_time").alias("total_time"),
        pred.alias("predicted_answer"),
    ).withColumn("is_correct", T.is_correct(F.col("predicted_answer"), F.col("correct_answer")))


_EV = duckdb_with("eval_log") + ", " + EVAL_RESULTS
CONTENT = ("coalesce(CASE WHEN json_valid(r.content) THEN "
           "json_extract_string(r.content, '$.choices[0].message.content') END, r.content)")


# ---------------------------------------------------------------- A7
@register("config_summary", _EV + """
SELECT keep_ratio, recovery_ratio, count(*) AS n,
       count(*) FILTER (WHERE api_success) AS n_success,
       count(*) FILTER (WHERE api_success AND is_correct) AS n_correct,
       round((count(*) FILTER (WHERE api_success AND is_correct)) / nullif(count(*) FILTER (WHERE api_success), 0), 6) AS accuracy,
       round(avg(embed_time) FILTER (WHERE api_success), 6) AS avg_embed_time,
       round(avg(api_call_time) FILTER (WHERE api_success), 6) AS avg_api_time,
       round(avg(pruned_token) FILTER (WHERE api_success), 6) AS avg_pruned_tokens,
       round((576.0 - avg(pruned_token) FILTER (WHERE api_success)) / 576.0 * 100.0, 6) AS token_reduction_pct
FROM results GROUP BY keep_ratio, recovery_ratio""")
def q_config_summary(spark, sf):
    return E.config_summary(eval_results(spark, sf))


# ---------------------------------------------------------------- F13
@register("parse_mc_answer", duckdb_with("eval_log") + f"""
SELECT test_number, generated_text, {mc_parse('generated_text')} AS predicted_answer FROM eval_log""")
def q_parse_mc_answer(spark, sf):
    e = tb.eval_log(spark, sf)
    return e.select("test_number", "generated_text", T.parse_mc_answer(F.col("generated_text")).alias("predicted_answer"))


# ---------------------------------------------------------------- F14
@register("parse_yes_no", duckdb_with("responses") + f"""
SELECT question_id, {yes_no('content')} AS predicted_answer FROM responses""")
def q_parse_yes_no(spark, sf):
    r = tb.responses(spark, sf)
    return r.select("question_id", T.parse_yes_no(F.col("content")).alias("predicted_answer"))


# ---------------------------------------------------------------- F19
@register("is_correct", _EV + """
SELECT test_number, predicted_answer, is_correct FROM results""")
def q_is_correct(spark, sf):
    return eval_results(spark, sf).select("test_number", "predicted_answer", "is_correct")


# ---------------------------------------------------------------- F9
_B = budget("keep_ratio", "recovery_ratio", "n_tokens")
@register("token_budget", duckdb_with("configs") + f"""
, g AS (SELECT label::BIGINT AS group_id, count(*)::INTEGER AS n_tokens FROM embeddings GROUP BY label
        UNION ALL SELECT -1::BIGINT, 576::INTEGER)
SELECT config_id, group_id, n_tokens, {_B['keep']} AS keep, {_B['important']} AS important,
       {_B['diverse']} AS diverse, {_B['recover']} AS recover, {_B['output']} AS output
FROM configs, g""")
def q_token_budget(spark, sf):
    """Budget per configuration for every group size found in the data,
    plus the reference's fixed 576-token image (group -1)."""
    emb = tb.raw(spark, sf, "embeddings")
    sizes = emb.groupBy(F.col("label").cast("bigint").alias("group_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n_tokens"))
    sizes = sizes.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("group_id"),
                                                    F.lit(tb.TOKENS_PER_IMAGE).alias("n_tokens")))
    swept = E.config_sweep(sizes, tb.configs(spark))
    b = T.token_budget("keep_ratio", "recovery_ratio", F.col("n_tokens"), F.col("important_ratio"))
    return swept.select("config_id", "group_id", "n_tokens", b["keep"].alias("keep"),
                        b["important"].alias("important"), b["diverse"].alias("diverse"),
                        b["recover"].alias("recover"), b["output"].alias("output"))


# ---------------------------------------------------------------- F10
@register("token_reduction_pct", _EV + """
SELECT test_number, pruned_token, round((576.0 - pruned_token) / 576.0 * 100.0, 6) AS token_reduction_pct
FROM results""")
def q_token_reduction(spark, sf):
    r = eval_results(spark, sf)
    return r.select("test_number", "pruned_token",
                    F.round(T.token_reduction_pct(F.col("pruned_token")), 6).alias("token_reduction_pct"))


# ---------------------------------------------------------------- F22
@register("timing_columns", _EV + """
SELECT test_number, round(total_time, 6) AS total_time FROM results""")
def q_timing_columns(spark, sf):
    return eval_results(spark, sf).select("test_number", F.round("total_time", 6).alias("total_time"))


# ---------------------------------------------------------------- P1
@register("successful_only", _EV + """
SELECT test_number, keep_ratio, recovery_ratio FROM results WHERE api_success""")
def q_successful_only(spark, sf):
    return E.successful_only(eval_results(spark, sf)).select("test_number", "keep_ratio", "recovery_ratio")


# ---------------------------------------------------------------- P2
@register("successful_with_prediction", _EV + """
SELECT test_number, predicted_answer FROM results WHERE api_success AND predicted_answer <> ''""")
def q_successful_with_prediction(spark, sf):
    return E.successful_with_prediction(eval_results(spark, sf)).select("test_number", "predicted_answer")


# ---------------------------------------------------------------- A9
@register("summary_by_ratio_key", _EV + """
SELECT 'keep_' || CAST(keep_ratio AS VARCHAR) || '_recovery_' || CAST(recovery_ratio AS VARCHAR) AS config_key,
       count(*) AS n, count(*) FILTER (WHERE is_correct) AS n_correct,
       round(count(*) FILTER (WHERE is_correct) / count(*), 6) AS accuracy,
       round(avg(embed_time), 6) AS avg_embed_time, round(avg(api_call_time), 6) AS avg_api_time,
       round(avg(pruned_token), 6) AS avg_pruned_tokens,
       round((576.0 - avg(pruned_token)) / 576.0 * 100.0, 6) AS token_reduction_pct
FROM results WHERE api_success GROUP BY 1""")
def q_summary_by_ratio_key(spark, sf):
    return E.summary_by_ratio_key(eval_results(spark, sf))


# ---------------------------------------------------------------- A7 + A15
@register("config_rollup", _EV + """
SELECT keep_ratio, recovery_ratio, CAST(grouping(keep_ratio, recovery_ratio) AS INTEGER) AS level,
       count(*) AS n, count(*) FILTER (WHERE api_success) AS n_success,
       count(*) FILTER (WHERE api_success AND is_correct) AS n_correct,
       round(count(*) FILTER (WHERE api_success) / count(*), 6) AS success_rate
FROM results GROUP BY ROLLUP (keep_ratio, recovery_ratio)""")
def q_config_rollup(spark, sf):
    return E.config_rollup(eval_results(spark, sf))


# ---------------------------------------------------------------- A11
@register("timing_summary", _EV + """
, ok AS (SELECT * FROM results WHERE api_success)
SELECT 'embed_time' AS metric, round(sum(embed_time), 6) AS total, round(avg(embed_time), 6) AS mean,
       round(min(embed_time), 6) AS min, round(max(embed_time), 6) AS max, round(stddev_samp(embed_time), 6) AS std FROM ok
UNION ALL
SELECT 'api_call_time', round(sum(api_call_time), 6), round(avg(api_call_time), 6), round(min(api_call_time), 6),
       round(max(api_call_time), 6), round(stddev_samp(api_call_time), 6) FROM ok
UNION ALL
SELECT 'total_time', round(sum(total_time), 6), round(avg(total_time), 6), round(min(total_time), 6),
       round(max(total_time), 6), round(stddev_samp(total_time), 6) FROM ok""")
def q_timing_summary(spark, sf):
    return E.timing_summary(eval_results(spark, sf))


# ---------------------------------------------------------------- A12
@register("accuracy_nonempty", _EV + """
SELECT count(*) AS n_predictions, count(*) FILTER (WHERE is_correct) AS n_correct,
       round(coalesce(count(*) FILTER (WHERE is_correct) / nullif(count(*), 0) * 100, 0.0), 6) AS accuracy_pct
FROM results WHERE api_success AND predicted_answer <> ''""")
def q_accuracy_nonempty(spark, sf):
    return E.accuracy_nonempty(eval_results(spark, sf))


# ---------------------------------------------------------------- A15
@register("overall_statistics", _EV + """
SELECT count(DISTINCT image_source) AS n_items, count(DISTINCT (keep_ratio, recovery_ratio)) AS n_configs,
       count(*) AS n_evaluations, count(*) FILTER (WHERE api_success) AS n_success,
       round(count(*) FILTER (WHERE api_success) / count(*), 6) AS success_rate
FROM results""")
def q_overall_statistics(spark, sf):
    return E.overall_statistics(eval_results(spark, sf), "image_source")


# ---------------------------------------------------------------- A13
@register("token_stats", _EV + """
SELECT 576 AS original_token, round(avg(pruned_token), 6) AS avg_pruned_token,
       round(avg(pruned_token) / 576.0, 6) AS kept_ratio FROM results WHERE api_success""")
def q_token_stats(spark, sf):
    ok = E.successful_only(eval_results(spark, sf))
    return ok.agg(F.avg("pruned_token").alias("p")).select(
        F.lit(tb.TOKENS_PER_IMAGE).alias("original_token"), F.round("p", 6).alias("avg_pruned_token"),
        F.round(F.col("p") / F.lit(float(tb.TOKENS_PER_IMAGE)), 6).alias("kept_ratio"))


# ---------------------------------------------------------------- A14
# Events hold one time before the call; these shares of it stand for its four parts.
_PARTS = {"project_time": 0.125, "preprocess_time": 0.125, "encode_time": 0.5, "prune_time": 0.25}


def _spread(col: str, short: str) -> str:
    return ", ".join(f"round({f}({col}), 6) AS {f}_{short}" for f in ("avg", "min", "max"))


@register("summary_min_max_avg", _EV + f"""
SELECT {", ".join(_spread(f"embed_time * {share}::DOUBLE", part) for part, share in _PARTS.items())},
       {_spread("embed_time", "embed_time")}, {_spread("api_call_time", "api_time")}, {_spread("total_time", "total_time")},
       round(sum(total_time), 6) AS sum_total_time, round(avg(pruned_token), 6) AS avg_tokens FROM results WHERE api_success""")
def q_summary_min_max_avg(spark, sf):
    parts = {part: F.col("embed_time") * F.lit(share) for part, share in _PARTS.items()}
    return E.summary_min_max_avg(eval_results(spark, sf).withColumns(parts))


# ---------------------------------------------------------------- W17
@register("test_number", duckdb_with("mc_items") + """
SELECT idx, row_number() OVER (ORDER BY idx)::BIGINT AS test_number FROM mc_items""")
def q_test_number(spark, sf):
    """1-based enumeration in item order.  A global order is one sorted
    sequence by definition: Spark range-partitions the sort and numbers
    the rows with a per-partition offset (no single-task window)."""
    items = tb.mc_items(spark, sf).select("idx")
    return E.global_row_number(items, "idx", "test_number")


# ---------------------------------------------------------------- J1
@register("config_sweep", duckdb_with("mc_items", "configs") + """
SELECT idx, config_id, keep_ratio, recovery_ratio FROM mc_items, configs""")
def q_config_sweep(spark, sf):
    items = tb.mc_items(spark, sf).select("idx")
    return E.config_sweep(items, tb.configs(spark)).select("idx", "config_id", "keep_ratio", "recovery_ratio")


# ---------------------------------------------------------------- J5 + F20 + F14 + F19
@register("response_join", duckdb_with("questions", "responses") + f"""
SELECT q.question_id, r.question_id IS NOT NULL AS api_success,
       {CONTENT} AS generated_text,
       CASE WHEN r.question_id IS NULL THEN '' ELSE {yes_no(CONTENT)} END AS predicted_answer,
       CASE WHEN r.question_id IS NULL THEN 'no response' ELSE '' END AS error_message
FROM questions q LEFT JOIN responses r ON q.question_id = r.question_id""")
def q_response_join(spark, sf):
    q = tb.questions(spark, sf).select("question_id")
    j = E.response_join(q, tb.responses(spark, sf))
    content = T.response_content(F.col("content"))
    return j.select(
        "question_id", "api_success", content.alias("generated_text"),
        F.when(F.col("api_success"), T.parse_yes_no(content)).otherwise(F.lit("")).alias("predicted_answer"),
        F.when(F.col("api_success"), F.lit("")).otherwise(F.lit("no response")).alias("error_message"),
    )


# ---------------------------------------------------------------- F20
@register("response_content", duckdb_with("eval_log") + """
, j AS (SELECT test_number, '{"choices":[{"message":{"content":' || CAST(to_json(generated_text) AS VARCHAR) || '}}]}' AS raw,
               CASE WHEN api_success THEN 'ok' ELSE '{"error":"' || category || '"}' END AS kind FROM eval_log)
SELECT test_number,
       CASE WHEN kind = 'ok' THEN coalesce(json_extract_string(raw, '$.choices[0].message.content'), raw)
            ELSE coalesce(json_extract_string(kind, '$.choices[0].message.content'), kind) END AS content,
       CASE WHEN kind = 'ok' THEN json_extract(raw, '$.choices[0]') IS NOT NULL
            ELSE json_extract(kind, '$.choices[0]') IS NOT NULL END AS has_choices
FROM j""")
def q_response_content(spark, sf):
    """Wrap each generated text in a chat response (errors as an error
    object), then take ``choices[0].message.content`` back out."""
    e = tb.eval_log(spark, sf)
    raw = F.concat(F.lit('{"choices":[{"message":{"content":'), T.json_string(F.col("generated_text")), F.lit("}}]}"))
    resp = F.when(F.col("api_success"), raw).otherwise(F.concat(F.lit('{"error":"'), F.col("category"), F.lit('"}')))
    return e.select("test_number", resp.alias("resp")).select(
        "test_number", T.response_content(F.col("resp")).alias("content"),
        T.has_choices(F.col("resp")).alias("has_choices"))


_ = (strip, trunc_int)
