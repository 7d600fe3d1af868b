"""Evaluation plans (C8-C10): prune, join answers, parse, score, summarise.

One lazy plan per run: each item is joined (by key) to its model response,
parsed and scored with built-in expressions once; the scored items are then
added up per image group, and only these sums are joined to the pruning
results, one per (config, image group), and added up per configuration. So no item
is repeated for a configuration.  The pruning result is computed once and re-used
by every question of that image (work sharing by an explicit aggregate + join
instead of a per-image cache).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..session import written
from ..sources.items import NO_PAYLOAD, payload_extract, payload_status, scan_with_defaults
from ..sources.tables import TOKENS_PER_IMAGE
from . import pruners as P

G = "group_id"
# Fixed value: the error of a question without an answer.
NO_RESPONSE = "No valid response from API"
# Cost model for prune time: output tokens pruned per second (its inverse is
# a repeating decimal, so averages never sit exactly on a rounding tie).
PRUNE_TOKENS_PER_SECOND = 3000.0


def pruned_counts(selection: DataFrame) -> DataFrame:
    """(config_id, group_id, pruned_token): tokens handed to the model."""
    return selection.groupBy("config_id", G).agg(F.count(F.lit(1)).cast("int").alias("pruned_token"))


def attach_pruning(rows: DataFrame, counts: DataFrame, configs: DataFrame) -> DataFrame:
    """Sweep ``rows`` (with a ``group_id``) over the grid and attach the
    token count of its group under each configuration (inner join: a
    group that failed to prune drops its rows, reported separately)."""
    swept = E.config_sweep(rows, configs)
    return swept.join(counts, ["config_id", G], "inner")


def group_totals(scored: DataFrame, item: str) -> DataFrame:
    """Per image group: items ``item``, rows, successes, correct ones, the sums of the
    times over successes, and ``shares``, the successes counted by 1 / rows of their item."""
    ok = F.col("api_success")
    spent = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(F.lit(0.0))) if c in scored.columns else F.lit(0.0)
    per_item = scored.groupBy(G, item).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_success"), F.count_if(ok & F.col("is_correct")).alias("n_correct"),
        spent("embed_time").alias("embed"), spent("api_call_time").alias("api"))
    return per_item.groupBy(G).agg(
        F.count(F.lit(1)).alias("items"), *[F.sum(c).alias(c) for c in ("n", "n_success", "n_correct", "embed", "api")],
        F.sum(F.col("n_success") / F.col("n")).alias("shares"))


def sweep_totals(totals: DataFrame, counts: DataFrame, configs: DataFrame) -> DataFrame:
    """The sums of every group under every configuration: (config, group) rows with
    ``pruned_token`` and ``prune_time``. Groups that failed to prune drop out."""
    swept = counts.join(configs.select("config_id", "keep_ratio", "recovery_ratio"), "config_id")
    return totals.join(swept, G).withColumn("prune_time", F.col("pruned_token") / F.lit(PRUNE_TOKENS_PER_SECOND))


def summary_of_totals(swept: DataFrame, keys, embed) -> DataFrame:
    """A7 from group sums; ``embed``: a group's summed embed time over successes."""
    mean = lambda c: F.round(F.sum(c) / F.nullif(F.sum("n_success"), F.lit(0)), 6)
    tokens = F.sum(F.col("pruned_token") * F.col("n_success")) / F.nullif(F.sum("n_success"), F.lit(0))
    return swept.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_success").alias("n_success"), F.sum("n_correct").alias("n_correct"),
        mean(F.col("n_correct")).alias("accuracy"), F.sum("items").alias("unique_images"),
        F.round(F.sum(F.col("items") * F.col("prune_time")), 6).alias("total_pruning_time"),
        F.round(F.sum("api"), 6).alias("total_api_call_time"),
        mean(embed).alias("avg_embed_time"), mean(F.col("api")).alias("avg_api_time"),
        F.round(tokens, 6).alias("avg_pruned_tokens"),
        F.round(T.token_reduction_pct(tokens, TOKENS_PER_IMAGE), 6).alias("token_reduction_pct"))


A7_COLS = ("n", "n_success", "n_correct", "accuracy", "avg_embed_time", "avg_api_time", "avg_pruned_tokens", "token_reduction_pct")


# C9
def mc_evaluation(items: DataFrame, responses: DataFrame, tokens: DataFrame, text_tokens: DataFrame,
                  configs: DataFrame, n_groups: int, presample_threshold: int | None = P.PRESAMPLE_THRESHOLD) -> DataFrame:
    """Multiple-choice sweep: prompt, prune (C1), response join, A-D parse,
    correctness, per-configuration summary (A7)."""
    it = items.select(
        F.col("idx").alias("item_id"), (F.col("idx") % n_groups).cast("bigint").alias(G),
        T.mc_prompt("question", "hint", "A", "B", "C", "D").alias("prompt"),
        T.null_to_empty("answer").alias("correct_answer"))
    sel = P.prune_attention_diverse(tokens, text_tokens, configs, presample_threshold=presample_threshold)
    content = T.response_content(F.col("content"))
    scored = E.response_join(it, responses, "item_id").select(
        "item_id", G,
        F.coalesce(F.col("embed_time"), F.lit(0.0)).alias("embed_time"),
        F.coalesce(F.col("api_call_time"), F.lit(0.0)).alias("api_call_time"),
        F.col("api_success"),
        F.when(F.col("api_success"), T.parse_mc_answer(content)).otherwise(F.lit("")).alias("predicted_answer"),
        "correct_answer",
    ).withColumn("is_correct", F.col("api_success") & T.is_correct(F.col("predicted_answer"), F.col("correct_answer")))
    swept = sweep_totals(group_totals(scored, "item_id"), pruned_counts(sel), configs)
    keys = ("keep_ratio", "recovery_ratio")
    return summary_of_totals(swept, keys, F.col("embed")).select(*keys, *A7_COLS)


def scored_questions(questions: DataFrame, responses: DataFrame, n_groups: int) -> DataFrame:
    """Per question: its image's group, response, yes/no parse and correctness (shared by C8 and C10)."""
    q = E.non_empty_questions(questions).select(
        "question_id", "image_id", (F.col("image_id") % n_groups).cast("bigint").alias(G),
        F.when(F.col("turn") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("answer"))
    j = E.response_join(q, responses.select("question_id", "content"), "question_id")
    content = T.response_content(F.col("content"))
    pred = F.when(F.col("api_success"), T.parse_yes_no(content)).otherwise(F.lit(""))
    return j.select(
        "question_id", "image_id", G, "api_success", pred.alias("predicted_answer"), "answer",
        F.when(F.col("api_success"), F.length("content") / 1000.0).otherwise(F.lit(0.0)).alias("api_call_time"),
    ).withColumn("is_correct", F.col("api_success") & T.is_correct(F.col("predicted_answer"), F.col("answer"), "lower"))


def question_results(questions: DataFrame, responses: DataFrame, counts: DataFrame, configs: DataFrame,
                     n_groups: int) -> DataFrame:
    """Per (config, question): pruned tokens of its image and the scored answer, where the result is wanted row by row."""
    return attach_pruning(scored_questions(questions, responses, n_groups), counts, configs).withColumn(
        "prune_time", F.col("pruned_token") / F.lit(PRUNE_TOKENS_PER_SECOND))


# C8 / A8
def prune_once_reuse(questions: DataFrame, responses: DataFrame, tokens: DataFrame, text_tokens: DataFrame,
                     configs: DataFrame, n_groups: int) -> DataFrame:
    """Prune each image once per configuration (C2), share the result with
    all its questions (J2), amortise the prune time over them (A6) and
    summarise per configuration with image-level totals (A8, A10)."""
    sel = P.prune_attention_textweighted(tokens, text_tokens, configs)
    swept = sweep_totals(group_totals(scored_questions(questions, responses, n_groups), "image_id"), pruned_counts(sel), configs)
    # a question's share of its image's prune time is 1 / questions of the image
    out = summary_of_totals(swept, ("config_id", "keep_ratio", "recovery_ratio"), F.col("shares") * F.col("prune_time"))
    return out.select("config_id", "keep_ratio", "recovery_ratio", "unique_images", "n", "n_success", "n_correct", "accuracy",
                      "total_pruning_time", "total_api_call_time", "avg_embed_time", "avg_api_time", "avg_pruned_tokens", "token_reduction_pct")


# C8, guided choices
def guided_results(items: DataFrame, responses: DataFrame, counts: DataFrame, configs: DataFrame,
                   n_groups: int) -> DataFrame:
    """Per (config, item): the response parsed against the item's own choices
    (F15, F16; yes / no where it has none), and how many items share the
    pruning result of its image (A1)."""
    it = items.select("item_id", (F.col("item_id") % n_groups).cast("bigint").alias(G), "correct_answer",
                      T.guided_choices("answers").alias("_choices"))
    j = E.response_join(it, responses, "item_id")
    pred = F.when(F.col("api_success"), T.parse_guided(T.response_content(F.col("content")), "_choices")).otherwise(F.lit(""))
    scored = j.select("item_id", G, "api_success", T.guided_choices_label("_choices").alias("guided_choices_used"),
                      pred.alias("predicted_answer"), "correct_answer") \
        .withColumn("is_correct", F.col("api_success") & T.is_correct("predicted_answer", "correct_answer", "strip"))
    asked = scored.groupBy(G).agg(F.count(F.lit(1)).alias("questions_used_for_pruning"))
    return attach_pruning(scored, counts.join(asked, G), configs)


# C10
# What a column that is absent holds; a name ending in _ gets the row's number.
YES_NO_DEFAULTS = {"question_id": "q_", "question": "", "category": "unknown", "image_source": "image_"}


def yes_no_scored(questions: DataFrame, images: DataFrame, responses: DataFrame, n_groups: int,
                  defaults=("question", "category")) -> DataFrame:
    """Per question, empty ones too: the columns named in ``defaults`` where
    absent (S2), the state of its image's payload (S3; an image without any is
    an error), response, yes/no parse and correctness. A question whose payload
    fails is not asked, so it is no success."""
    q = scan_with_defaults(questions, "question_id", {c: YES_NO_DEFAULTS[c] for c in defaults}).select(
        "question_id", "question", *[c for c in ("category", "image_source") if c in defaults or c in questions.columns],
        "image_id", (F.col("image_id") % n_groups).cast("bigint").alias(G),
        F.when(F.col("turn") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("answer"))
    usable = images.select("image_id", payload_status(payload_extract(F.col("image"))).alias("_status")) \
        .groupBy("image_id").agg(F.max("_status").alias("_status"))  # 'ok' where one payload is
    q = q.join(usable, "image_id", "left").withColumn("_status", F.coalesce("_status", F.lit(NO_PAYLOAD)))
    j = E.response_join(q, responses.select("question_id", "content"), "question_id") \
        .withColumn("api_success", F.col("api_success") & (F.col("_status") == "ok"))
    pred = F.when(F.col("api_success"), T.parse_yes_no(T.response_content(F.col("content")))).otherwise(F.lit(""))
    error = F.when(F.col("_status") != "ok", F.col("_status")).when(~F.col("api_success"), F.lit(NO_RESPONSE)).otherwise(F.lit(""))
    return j.select(
        *q.drop("_status").columns, "api_success", pred.alias("predicted_answer"), error.alias("error_message"),
        F.when(F.col("api_success"), F.col("content")).otherwise(F.lit("")).alias("generated_text"),
        F.when(F.col("api_success"), F.length("content") / 1000.0).otherwise(F.lit(0.0)).alias("api_call_time"),
    ).withColumn("is_correct", F.col("api_success") & T.is_correct(F.col("predicted_answer"), F.col("answer"), "lower"))


def yes_no_records(questions: DataFrame, images: DataFrame, responses: DataFrame, tokens: DataFrame, text_tokens: DataFrame,
                   configs: DataFrame, n_groups: int) -> DataFrame:
    """The result record of every (configuration, question); a question whose
    payload fails has no tokens."""
    scored = yes_no_scored(questions, images, responses, n_groups, tuple(YES_NO_DEFAULTS))
    counts = pruned_counts(P.prune_attention_textweighted(tokens, text_tokens, configs))
    usable = F.col("error_message").isin("", NO_RESPONSE)
    return attach_pruning(scored, counts, configs).select(
        "config_id", "keep_ratio", "recovery_ratio", "question_id", "question", F.col("answer").alias("correct_answer"), "image_source",
        "category", "predicted_answer", "is_correct", "api_success", "generated_text", "error_message",
        F.lit(576).alias("original_tokens"), F.when(usable, F.col("pruned_token")).otherwise(F.lit(0)).alias("pruned_tokens"))


def yes_no_evaluation(questions: DataFrame, images: DataFrame, responses: DataFrame, tokens: DataFrame, text_tokens: DataFrame,
                      configs: DataFrame, n_groups: int) -> DataFrame:
    """Per question (no grouping): defaults and payload (S2, S3), prune (C2),
    respond, parse yes/no, and three summaries, told apart by ``level``: each
    configuration (A7), the successes by ratio key (A9), and all evaluations
    together (A15)."""
    sel = P.prune_attention_textweighted(tokens, text_tokens, configs)
    totals = group_totals(yes_no_scored(questions, images, responses, n_groups), "image_id")
    swept = written(sweep_totals(totals, pruned_counts(sel), configs), "evaluation-sums")  # configurations x groups
    embed = F.col("n_success") * F.col("prune_time")
    keys = ("keep_ratio", "recovery_ratio")
    key = F.concat(F.lit("keep_"), F.col("keep_ratio").cast("string"), F.lit("_recovery_"), F.col("recovery_ratio").cast("string"))

    def level(name: str, df: DataFrame, **cols) -> DataFrame:
        empty = {c: F.lit(None).cast(t) for c, t in (("keep_ratio", "double"), ("recovery_ratio", "double"), ("config_key", "string"),
                                                     ("n_configs", "bigint"), ("success_rate", "double"), ("unique_images", "bigint"))}
        have = empty | {c: F.col(c) for c in empty if c in df.columns} | cols
        return df.select(F.lit(name).alias("level"), *[v.alias(c) for c, v in have.items()], *A7_COLS)

    rate = F.round(F.col("n_success") / F.col("n"), 6)
    by_config = level("configuration", summary_of_totals(swept, keys, embed), unique_images=F.lit(None).cast("bigint"))
    successes = swept.where("n_success > 0").withColumn("config_key", key).withColumn("n", F.col("n_success"))
    by_key = level("ratio_key", summary_of_totals(successes, ("config_key",), embed), unique_images=F.lit(None).cast("bigint"))
    per_config = summary_of_totals(swept, ("config_id",), embed)
    overall = summary_of_totals(swept, (), embed).crossJoin(per_config.agg(
        F.count(F.lit(1)).alias("n_configs"), F.max("unique_images").alias("_images")))  # one row each
    overall = level("overall", overall, unique_images=F.col("_images"), success_rate=rate)
    return by_config.unionByName(by_key).unionByName(overall.where("n is not null"))
