"""Model-backed row operators (U1-U5): semantic filter, batch inference,
semantic map, chat message lists.

The model call is a user-supplied *predictor*::

    predictor(records: list[dict], prompt: str, choices: list[str] | None) -> list[str]

It receives whole Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``
rows at a time) on the executors.  Each distinct tuple of template fields
is asked once: the operator first reduces the input to its distinct field
tuples (a partial aggregate before the shuffle, so a hot tuple costs one
call), runs the predictor with ``mapInArrow``, and joins the answers back.
The predictor is treated as deterministic (temperature 0), which lets
Catalyst push cheap predicates below it.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip_label
from .evaluate import global_row_number

Predictor = Callable[[list, str, "list[str] | None"], list]

# Choices of a semantic filter and the answer that keeps a row.
FILTER_CHOICES = ("true", "false")
KEEP_ANSWER = "true"


def template_fields_py(template: str) -> list[str]:
    """Placeholders of a driver-side template (non-greedy, keeps ``{}``)."""
    return re.findall(r"{(.*?)}", template)


class KeywordPredictor:
    """Deterministic stand-in model: answers ``true`` / ``false`` whether the
    first field value contains a keyword (case-insensitive)."""

    def __init__(self, keyword: str, positive: str = "true", negative: str = "false"):
        self.keyword = keyword.lower()
        self.positive, self.negative = positive, negative

    def __call__(self, records, prompt, choices=None):
        out = []
        for r in records:
            v = next(iter(r.values()), None) if r else None
            out.append(self.positive if v is not None and self.keyword in str(v).lower() else self.negative)
        return out


class EchoPredictor:
    """Deterministic stand-in for free-text generation: renders the prompt."""

    def __call__(self, records, prompt, choices=None):
        out = []
        for r in records:
            text = prompt
            for k, v in r.items():
                text = text.replace("{" + k + "}", "" if v is None else str(v))
            out.append(text)
        return out


def _answer_batches(fields: list[str], template: str, predictor: Predictor, choices, out_col: str):
    """mapInArrow body: predictor over whole Arrow batches of field tuples."""
    names = list(fields)
    ch = list(choices) if choices is not None else None

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(names))]
            records = [dict(zip(names, vals)) for vals in zip(*cols)]
            answers = predictor(records, template, ch) if records else []
            if len(answers) != len(records):
                raise ValueError(f"predictor returned {len(answers)} answers for {len(records)} rows")
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(names))]
                + [pa.array([None if a is None else str(a) for a in answers], pa.string())],
                names=[f"_k{i}" for i in range(len(names))] + [out_col])

    return run


# U2 / U3
def batch_infer(df: DataFrame, template: str, predictor: Predictor, out_col: str = "answer",
                choices=None, strip_labels: bool = False) -> DataFrame:
    """Add ``out_col`` = the predictor's answer for each row's template fields.

    Each distinct field tuple is inferred once (``distinct`` is a partial
    aggregate before its shuffle); answers are joined back null-safely.
    """
    fields = [f for f in template_fields_py(template) if f]
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"template fields {missing} are not columns of the input")
    if not fields:
        raise ValueError("template names no column")
    n = len(fields)
    str_cols = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    keys = [(strip_label(F.col(f), f) if strip_labels and f in str_cols else F.col(f)).alias(f"_k{i}")
            for i, f in enumerate(fields)]
    tagged = df.select("*", *keys)
    distinct = tagged.select(*[f"_k{i}" for i in range(n)]).distinct()
    out_schema = StructType(list(distinct.schema.fields) + [StructField(out_col, StringType())])
    answered = distinct.mapInArrow(_answer_batches(fields, template, predictor, choices, out_col), out_schema)
    answered = answered.select(*[F.col(f"_k{i}").alias(f"_a{i}") for i in range(n)], out_col)
    cond = [tagged[f"_k{i}"].eqNullSafe(answered[f"_a{i}"]) for i in range(n)]
    return tagged.join(answered, cond, "left").select(*df.columns, out_col)


sem_map = batch_infer


# U1 / P6
def sem_filter(df: DataFrame, template: str, predictor: Predictor, strip_labels: bool = True) -> DataFrame:
    """Keep rows for which the model answers ``true`` to the templated question.

    The ``"<field>: "`` label is removed from string fields first (first
    occurrence, anywhere), as the reference does.
    """
    answered = batch_infer(df, template, predictor, "_sem_answer", FILTER_CHOICES, strip_labels)
    return answered.where(F.lower(F.col("_sem_answer")) == KEEP_ANSWER).drop("_sem_answer")


def register_sem_map_udf(spark, name: str, predictor: Predictor, template: str):
    """Register ``name(named_struct(field, value, ...))`` as a SQL function
    (Arrow-batched pandas UDF) answering ``template`` for the field values."""
    fields = [f for f in template_fields_py(template) if f]

    @pandas_udf("string")
    def _udf(s: pd.DataFrame) -> pd.Series:
        records = [dict(zip(fields, vals)) for vals in zip(*[s[f].tolist() for f in fields])]
        return pd.Series(predictor(records, template, None), dtype="object")

    spark.udf.register(name, _udf)
    return _udf


# U5
def chat_messages_long(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages as rows (conv, turn, role, content, 0-based position) and a flag
    for the variant without the system turn.

    Positions come from a range-partitioned global numbering minus the
    conversation's first number, so one huge conversation is spread over
    many tasks instead of being sorted in one.
    """
    c = conversations.select(conv, turn, "role", F.col("text").alias("content"))
    numbered = global_row_number(c, [conv, turn], "_g")
    first = numbered.groupBy(conv).agg(F.min("_g").alias("_g0"))
    out = numbered.join(first, conv)
    return out.select(conv, turn, "role", "content", (F.col("_g") - F.col("_g0")).cast("bigint").alias("position"),
                      (F.col("role") != "system").alias("kept_without_system"))


def chat_messages(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  drop_system: bool = False) -> DataFrame:
    """One array<struct<role, content>> per conversation, in turn order.

    For bounded conversations (the array is the product); use
    ``chat_messages_long`` when a conversation may be unbounded.
    """
    c = conversations
    if drop_system:
        c = c.where(F.col("role") != "system")
    msgs = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("role").alias("role"),
                                                F.col("text").alias("content"))))
    return c.groupBy(conv).agg(F.transform(msgs, lambda m: F.struct(m["role"].alias("role"),
                                                                     m["content"].alias("content"))).alias("messages"))


def missing_field_status(df: DataFrame, fields: list[str]) -> Column:
    """Dead-letter text naming the first null template field, else null."""
    out = None
    for f in fields:
        cond = F.col(f).isNull()
        out = F.when(cond, F.lit(f"missing field: {f}")) if out is None else out.when(cond, F.lit(f"missing field: {f}"))
    return out if out is not None else F.lit(None).cast("string")
