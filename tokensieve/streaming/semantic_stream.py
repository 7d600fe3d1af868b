"""Streaming semantic map (U4): per-row model answers on a stream.

``answer_stream`` asks each distinct field tuple once over the whole stream,
across micro-batches and restarts. Three checkpointed queries work on one folder:
the rows with their dead-letter status are staged; tuples not yet seen
(``dropDuplicates`` state by the tuple's SHA-256) go to the predictor in Arrow
batches; the staged rows are joined with the answers. A second call on the same
folder takes up what arrived since.

``stream_sem_map`` is the form without state: dead-letter status, then the
predictor, asked once for each distinct tuple of an Arrow batch.

File sinks are exactly-once, so a lost executor or a restart neither drops nor
duplicates rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.semantic import Predictor, missing_field_status, template_fields_py
from ..session import ensure_checkpoint_dir

#: Copies of an answer that the rows of its tuple are spread over.
COPIES = 16


def stream_sem_map(stream: DataFrame, template: str, predictor: Predictor, key_cols: list[str],
                   out_col: str = "answer") -> DataFrame:
    """Streaming DataFrame with ``status`` and ``out_col`` added (null answer
    and ``missing field: <name>`` status for rows lacking a field)."""
    fields = [f for f in template_fields_py(template) if f]
    s = stream.select(*key_cols, *fields).withColumn("status", missing_field_status(stream, fields))
    names = list(s.columns)
    idx = {n: i for i, n in enumerate(names)}

    def run(batches):
        for b in batches:
            status = b.column(idx["status"]).to_pylist()
            cols = [b.column(idx[f]).to_pylist() for f in fields]
            recs, where, cache = [], [], {}
            for i, st in enumerate(status):
                if st is None:
                    key = tuple(c[i] for c in cols)
                    if key not in cache:
                        cache[key] = len(recs)
                        recs.append(dict(zip(fields, key)))
                    where.append(cache[key])
                else:
                    where.append(None)
            answers = predictor(recs, template, None) if recs else []
            out = [None if w is None else answers[w] for w in where]
            st2 = ["ok" if s0 is None else s0 for s0 in status]
            arrays = [b.column(i) for i in range(len(names)) if names[i] != "status"]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(st2, pa.string()), pa.array(out, pa.string())],
                names=[n for n in names if n != "status"] + ["status", out_col])

    base = [f for f in s.schema.fields if f.name != "status"]
    schema = StructType(base + [StructField("status", StringType()), StructField(out_col, StringType())])
    return s.select(*[n for n in names if n != "status"], "status").mapInArrow(run, schema)


def run_available_now(spark: SparkSession, streamed: DataFrame, name: str) -> DataFrame:
    """Drain everything available into a parquet table under the session's
    ``spark.checkpoint.dir`` (with its own streaming checkpoint) and return
    that table as a batch DataFrame."""
    base = ensure_checkpoint_dir(spark)
    run = f"{name}-{uuid.uuid4().hex[:12]}"
    out = os.path.join(base, "streams", run, "data")
    ckpt = os.path.join(base, "streams", run, "checkpoint")
    return _drained(spark, streamed, out, ckpt)


def _drained(spark: SparkSession, streamed: DataFrame, out: str, checkpoint: str) -> DataFrame:
    q = (streamed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(out)


def tuple_hash(df: DataFrame, fields: list[str]) -> Column:
    """SHA-256 of the fields' values, each with its length in front."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    text = [F.hex(c) if kinds[c] == "binary" else F.col(c).cast("string") for c in fields]
    return F.sha2(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each hash in a batch, so that a hot tuple is not shuffled row by row."""
    for b in batches:
        places = pa.table({"h": b.column(0), "i": pa.array(range(b.num_rows), pa.int64())})
        yield b.take(places.group_by("h").aggregate([("i", "min")]).column("i_min").combine_chunks())


def answer_stream(spark: SparkSession, stream: DataFrame, template: str, predictor: Predictor, key_cols: list[str],
                  folder: str, out_col: str = "answer") -> DataFrame:
    """Answers what is available of the stream and returns all rows answered in
    ``folder`` so far: ``key_cols``, the template's fields, ``status`` and ``out_col``.

    Defined results: a row that lacks a field has the status ``missing field: <name>``
    and a null answer; repeated rows keep a row each; an empty stream gives no rows.
    """
    fields = [f for f in template_fields_py(template) if f]
    columns = list(dict.fromkeys([*key_cols, *fields]))
    # `_part` decides no result, only which copy of its answer a row meets
    rows = stream.select(*columns, missing_field_status(stream, fields).alias("status"), tuple_hash(stream, fields).alias("_h"),
                         (F.rand() * COPIES).cast("int").alias("_part"))
    _drained(spark, rows, f"{folder}/rows", f"{folder}/rows-checkpoint")
    staged = spark.readStream.schema(rows.schema).parquet(f"{folder}/rows")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [b.column(i + 1).to_pylist() for i in range(len(fields))]
            records = [dict(zip(fields, v)) for v in zip(*values)]
            answers = predictor(records, template, None) if records else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string())], names=["_of", "_answer"])

    wanted = staged.where("status is null").select("_h", *fields)
    unseen = wanted.mapInArrow(_first_of_each, wanted.schema).dropDuplicates(["_h"])
    answers = _drained(spark, unseen.mapInArrow(ask, "_of string, _answer string"), f"{folder}/answers", f"{folder}/answers-checkpoint")
    # a hot tuple's rows are spread over copies of its answer
    copies = answers.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    found = staged.join(copies, (F.col("_h") == F.col("_of")) & (F.col("_part") == F.col("_copy")) & F.col("status").isNull(), "left")
    out = found.select(*columns, F.coalesce("status", F.lit("ok")).alias("status"), F.col("_answer").alias(out_col))
    return _drained(spark, out, f"{folder}/answered", f"{folder}/answered-checkpoint")
