"""Canonical tables over the given parquet files.

Each canonical table is a plain DataFrame derived from the raw tables, so
its work grows with them.  The DuckDB text of the same view lives next to
it in ``DUCKDB_VIEWS`` and is what the SQL oracles are built on.

Design notes for scale
* ``tokens.token_idx`` is the source ``vec_id``: unique inside a group and
  in the same order as a dense 0-based position, so every "first token" and
  tie-break rule is unchanged, and no window over a (possibly huge) group
  is needed to number the tokens.
* ``text_tokens`` is a share of each label's vectors chosen by a hash, so the
  question side grows with the table and is a filter on the scan.
* ``question_id`` names the conversation and the turn, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import uniform, uniform_sql_duckdb

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The reference's configuration grid (keep x recovery, 12 rows),
# its important share 0.6 and the per-image token count 576.
KEEP_RATIOS = (0.05, 0.1, 0.25, 0.5)
RECOVERY_RATIOS = (0.05, 0.1, 0.2)
IMPORTANT_RATIO = 0.6
TOKENS_PER_IMAGE = 576
# One vector in eight is a question vector, about the reference's ratio of text to image tokens.
QUESTION_SHARE = 0.125
QUESTION_SEED = 5


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(group_id bigint, token_idx bigint, vec array<double>, cls_score double)."""
    emb = raw(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("label").cast("bigint").alias("group_id"),
        F.col("vec_id").cast("bigint").alias("token_idx"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.abs(F.col("embedding")[0].cast("double")).alias("cls_score"),
    )


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_tokens(group_id bigint, t_idx bigint, vec array<double>).

    The vectors of label ``g`` that the hash of their id chooses serve as the
    question vectors of the group before it, and those of the first label for
    the last group (labels count from 0).
    """
    emb = raw(spark, sf_dir, "embeddings")
    labels = emb.agg((F.max("label") + 1).alias("_labels"))  # one row
    chosen = emb.where(uniform(QUESTION_SEED, F.col("vec_id")) <= QUESTION_SHARE)
    return chosen.crossJoin(F.broadcast(labels)).select(
        ((F.col("label") + F.col("_labels") - 1) % F.col("_labels")).cast("bigint").alias("group_id"),
        F.col("vec_id").cast("bigint").alias("t_idx"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def _turn_id(turn) -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions(question_id, image_id, turn, question): user turns."""
    c = raw(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select(
        _turn_id(F.col("turn")).alias("question_id"),
        F.col("conv_id").alias("image_id"),
        "turn",
        F.col("text").alias("question"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses(question_id, content): the assistant turn that follows."""
    c = raw(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "assistant").select(
        _turn_id(F.col("turn") - 1).alias("question_id"),
        F.col("text").alias("content"),
    )


def payload_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_variants(image_id, image): payloads of three kinds, and every fourth of none."""
    p = raw(spark, sf_dir, "pages")
    kind = lambda k: F.when(F.col("page_id") % 4 == k, F.col("html").cast("binary"))
    return p.select(F.col("page_id").alias("image_id"),
                    F.struct(*[kind(k).alias(f) for k, f in enumerate(("bytes", "data", "binary"))]).alias("image"))


def mc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice items built from ``part``."""
    p = raw(spark, sf_dir, "part")
    answers = F.concat(
        F.lit('[{"answer":" '), F.col("p_brand"), F.lit(' "},{"answer":"'),
        F.lower("p_brand"), F.lit('"},"'), F.col("p_type"), F.lit('",{"x":1}]'),
    )
    return p.select(
        F.col("p_partkey").alias("idx"),
        F.col("p_name").alias("question"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("hint"),
        F.col("p_brand").alias("A"),
        F.col("p_type").alias("B"),
        F.col("p_size").cast("string").alias("C"),
        F.lit(None).cast("string").alias("D"),
        F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), 1).alias("answer"),
        answers.alias("answers"),
    )


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluated (item, configuration) per event."""
    e = raw(spark, sf_dir, "events")
    keep = (
        F.when(F.col("user_id") % 4 == 0, 0.05).when(F.col("user_id") % 4 == 1, 0.1)
        .when(F.col("user_id") % 4 == 2, 0.25).otherwise(0.5)
    )
    rec = F.when(F.col("user_id") % 3 == 0, 0.05).when(F.col("user_id") % 3 == 1, 0.1).otherwise(0.2)
    text = (
        F.when(F.col("event_type") == "click", F.lit("A"))
        .when(F.col("event_type") == "view", F.lit(" b) maybe\n"))
        .when(F.col("event_type") == "purchase", F.lit("ANSWER: C)"))
        .when(F.col("event_type") == "signup", F.lit("d"))
        .otherwise(F.lit(""))
    )
    return e.select(
        F.col("event_id").alias("test_number"),
        F.col("user_id").cast("string").alias("image_source"),
        keep.alias("keep_ratio"),
        rec.alias("recovery_ratio"),
        (F.col("value") / 1000).alias("embed_time"),
        (F.col("value") / 100).alias("api_call_time"),
        (F.col("event_type") != "error").alias("api_success"),
        text.alias("generated_text"),
        F.substring(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), 1).alias("correct_answer"),
        F.col("event_type").alias("category"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """images(image_source, payload binary, page_id)."""
    p = raw(spark, sf_dir, "pages")
    return p.select(
        F.col("url").alias("image_source"),
        F.col("html").cast("binary").alias("payload"),
        "page_id",
    )


def configs(spark: SparkSession, keep_ratios=KEEP_RATIOS, recovery_ratios=RECOVERY_RATIOS,
            important_ratio: float = IMPORTANT_RATIO, text_weights=(None,)) -> DataFrame:
    """Configuration grid: keep x recovery (x text weight), ``config_id`` 0-based.

    A parameter table (12 rows by default); it is crossed with real data,
    never used alone.
    """
    rows = []
    for k in keep_ratios:
        for r in recovery_ratios:
            for w in text_weights:
                rows.append((len(rows), float(k), float(r), float(important_ratio),
                             None if w is None else float(w)))
    return spark.createDataFrame(
        rows,
        "config_id int, keep_ratio double, recovery_ratio double, "
        "important_ratio double, text_guidance_weight double",
    )


# --------------------------------------------------------------------------
# DuckDB text of the same views (the SQL oracles are built on these).
# --------------------------------------------------------------------------
DUCKDB_VIEWS = {
    "tokens": """SELECT label::BIGINT AS group_id, vec_id::BIGINT AS token_idx,
        embedding::DOUBLE[] AS vec, abs(embedding[1]::DOUBLE) AS cls_score FROM embeddings""",
    "text_tokens": f"""SELECT ((label + labels - 1) % labels)::BIGINT AS group_id, vec_id::BIGINT AS t_idx, embedding::DOUBLE[] AS vec
        FROM embeddings, (SELECT max(label) + 1 AS labels FROM embeddings)
        WHERE {uniform_sql_duckdb(QUESTION_SEED, 'vec_id')} <= {QUESTION_SHARE}""",
    "questions": """SELECT conv_id || ':' || turn AS question_id, conv_id AS image_id, turn,
        text AS question FROM conversations WHERE role = 'user'""",
    "responses": """SELECT conv_id || ':' || (turn - 1) AS question_id, text AS content
        FROM conversations WHERE role = 'assistant'""",
    "mc_items": """SELECT p_partkey AS idx, p_name AS question,
        CASE WHEN p_size % 2 = 0 THEN p_type END AS hint, p_brand AS A, p_type AS B,
        CAST(p_size AS VARCHAR) AS C, CAST(NULL AS VARCHAR) AS D,
        substr('ABCD', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS answer,
        '[{"answer":" ' || p_brand || ' "},{"answer":"' || lower(p_brand) || '"},"' || p_type || '",{"x":1}]' AS answers
        FROM part""",
    "eval_log": """SELECT event_id AS test_number, CAST(user_id AS VARCHAR) AS image_source,
        CASE user_id % 4 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS keep_ratio,
        CASE user_id % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS recovery_ratio,
        value / 1000 AS embed_time, value / 100 AS api_call_time, event_type <> 'error' AS api_success,
        CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN ' b) maybe' || chr(10)
             WHEN 'purchase' THEN 'ANSWER: C)' WHEN 'signup' THEN 'd' ELSE '' END AS generated_text,
        substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1) AS correct_answer,
        event_type AS category FROM events""",
    "images": """SELECT url AS image_source, encode(html) AS payload, page_id FROM pages""",
    "configs": """SELECT (row_number() OVER (ORDER BY k, r) - 1)::INTEGER AS config_id, k AS keep_ratio,
        r AS recovery_ratio, 0.6::DOUBLE AS important_ratio, CAST(NULL AS DOUBLE) AS text_guidance_weight
        FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) kt(k),
             (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) rt(r)""",
}

def duckdb_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named canonical views."""
    parts = [f"{n} AS ({DUCKDB_VIEWS[n]})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
