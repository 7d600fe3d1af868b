"""Relational selection steps.

A selection is a table ``(keys..., token_idx, stage, rank, position)``:
``rank`` orders tokens inside a stage, ``position`` is the token's place
in the output sequence (selected tokens sorted by index, then recovered
tokens in score order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, uniform
from ..session import written
from .groupwise import group_rank, group_top
from .tiles import attention_sums


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def rank_desc(df: DataFrame, keys, score: str, out: str = "score_rank", largest: int | None = 0) -> DataFrame:
    """0-based rank by descending score; ties -> lower ``token_idx`` first.
    ``largest``: a bound of the group size (``None`` = unknown -> the plan
    that spreads a hot group over many tasks)."""
    return group_rank(df, keys, [F.desc(score), F.asc("token_idx")], out, largest)


def top_desc(df: DataFrame, keys, score: str, k) -> DataFrame:
    """The ``k`` rows of largest score a group, ranked like ``rank_desc``."""
    return group_top(df, keys, [F.desc(score), F.asc("token_idx")], "rank", k, 0)


# W1
def important_topk(df: DataFrame, keys, score: str, k) -> DataFrame:
    """Top-k rows by score per group.  With a literal ``k`` Spark plans a
    partial WindowGroupLimit before the shuffle (hot groups are cut
    map-side); with a per-row ``k`` column the rank is computed once and
    filtered, which serves every configuration from one window."""
    return top_desc(df, keys, score, k)


# O5 / P7
def set_difference(all_rows: DataFrame, selected: DataFrame, keys) -> DataFrame:
    return all_rows.join(selected.select(*_keys(keys), "token_idx"), [*_keys(keys), "token_idx"], "left_anti")


# O4
def union_stages(*stages: DataFrame) -> DataFrame:
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


# O2
def sort_selected(selected: DataFrame, keys, largest: int | None = 0) -> DataFrame:
    """Output position = ascending token order of the selected set."""
    return group_rank(selected, keys, [F.asc("token_idx")], "position", largest)


# O3
def append_recovered(sorted_sel: DataFrame, recovered: DataFrame, keys) -> DataFrame:
    """Recovered tokens follow the sorted selection, in recovery-rank order."""
    ks = _keys(keys)
    counts = sorted_sel.groupBy(*ks).agg(F.count(F.lit(1)).cast("int").alias("_ns"))
    rec = recovered.join(counts, ks, "left").withColumn(
        "position", (F.coalesce(F.col("_ns"), F.lit(0)) + F.col("rank")).cast("int")).drop("_ns")
    return sorted_sel.unionByName(rec, allowMissingColumns=True)


# V6
def weighted_sample(df: DataFrame, keys, weight: str, m, seed: int = 42, out: str = "sample_rank",
                    largest: int | None = 0) -> DataFrame:
    """Weighted sampling without replacement (Efraimidis-Spirakis): rank by
    ``-ln(u) / w`` with a seeded uniform ``u``; keep ranks below ``m``."""
    ks = _keys(keys)
    u = uniform(seed, *[F.col(c) for c in ks], F.col("token_idx"))
    # zero / missing weight: never drawn before a positive one (key +inf)
    d = df.withColumn("_key", F.when(F.col(weight) > 0, -F.log(u) / F.col(weight)).otherwise(F.lit(float("inf"))))
    return group_top(d, ks, [F.asc("_key"), F.asc("token_idx")], out, m, largest).drop("_key")


# V7
def uniform_sample(df: DataFrame, keys, m, seed: int = 42, out: str = "sample_rank",
                   largest: int | None = 0) -> DataFrame:
    ks = _keys(keys)
    d = df.withColumn("_u", uniform(seed, *[F.col(c) for c in ks], F.col("token_idx")))
    return group_top(d, ks, [F.asc("_u"), F.asc("token_idx")], out, m, largest).drop("_u")


# W13
def recover_topk(pruned: DataFrame, text_tokens: DataFrame, keys, k, group_col: str = "group_id") -> DataFrame:
    """Among unselected tokens: per question vector a softmax over them of
    the raw dot product, mean over question vectors, top-k."""
    return top_desc(recovery_scores(pruned, text_tokens, keys, group_col), keys, "recovery_score", k)


def recovery_scores(pruned: DataFrame, text_tokens: DataFrame, keys, group_col: str = "group_id", carry=()) -> DataFrame:
    """(keys, token_idx, recovery_score, carry): mean attention of the question
    vectors of ``group_col``, one softmax a vector over the tokens of ``keys``."""
    ks = _keys(keys)
    own = written(pruned.select(*ks, "token_idx", "vec", *carry), "pruned-tokens")
    questions = text_tokens.select(F.col(group_col), "t_idx", "vec")
    if ks != [group_col]:  # the group's question vectors for each key that has tokens
        questions = questions.join(own.select(*ks).distinct(), group_col)
    questions = written(questions.select(*ks, "t_idx", "vec"), "question-vectors")
    sums = attention_sums(own, questions, ks).select(*ks, "token_idx", (F.col("attention") / F.col("n_questions")).alias("recovery_score"))
    return sums.join(own.select(*ks, "token_idx", *carry), [*ks, "token_idx"]) if carry else sums


# W14
def recover_by_attention_sum(pruned: DataFrame, attention: DataFrame, keys, k) -> DataFrame:
    """Recovery by attention summed over the question rows (``attention_sums``)."""
    ks = _keys(keys)
    s = attention.join(pruned.select(*ks, "token_idx"), [*ks, "token_idx"]).withColumnRenamed("attention", "recovery_score")
    return top_desc(s, ks, "recovery_score", k)


# W15
def recover_by_cls(pruned: DataFrame, keys, k, score: str = "cls_score") -> DataFrame:
    return top_desc(pruned, keys, score, k)


# W16
def topk_text_by_norm(text_tokens: DataFrame, k: int, group_col: str = "group_id") -> DataFrame:
    """Keep the ``k`` question vectors with the largest norm per group."""
    t = text_tokens.withColumn("_norm", F.sqrt(dot("vec", "vec")))
    w = Window.partitionBy(group_col).orderBy(F.desc("_norm"), F.asc("t_idx"))
    return t.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_norm")
