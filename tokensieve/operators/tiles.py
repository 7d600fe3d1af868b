"""Token-by-question matrices in tiles.

The tokens and the question vectors of a group are dealt by hash to blocks of
about ``tile`` rows, and every (token block, question block) is one tile: a
matrix product in one task, whatever the size of the group. A tile returns one
partial state a token or a question vector - a maximum, a sum, or the
maximum and the sum of exponentials of an online softmax - and states are
merged by ordinary aggregates. A row for each (token, question vector) exists
only where it is the result (J7).

Defined results: a token or question vector that is null takes no part; a group
without question vectors, or an empty table, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TILE = 1024
# Fixed value: the guard of the reference's entropy score.
ENTROPY_EPS = 1e-10


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks()
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def tiles(tokens: DataFrame, questions: DataFrame, keys: Iterable[str], fn: Callable, out: str,
          token_cols=(), question_cols=(), tile: int = TILE) -> DataFrame:
    """``fn(token ids, vectors, extra columns, question ids, vectors, extra columns)``
    of every tile of each group; it returns the columns named in ``out``.

    ``tokens`` holds (keys, token_idx, vec, token_cols), ``questions`` (keys,
    t_idx, vec, question_cols); the extra columns are doubles.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    tokens, questions = (d.where(F.col("vec").isNotNull()) for d in (tokens, questions))

    def blocks(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias(name))

    dims = blocks(tokens, "_nt").join(blocks(questions, "_nq"), keys)

    def side(d: DataFrame, ident: str, extra, own: str, other: str, place: str, across: str) -> DataFrame:
        return d.join(dims, keys).select(
            *keys, F.pmod(F.xxhash64(ident), F.col(own)).cast("int").alias(place),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(across),
            F.lit(ident == "token_idx").alias("_token"), F.col(ident).cast("bigint").alias("_id"), F.col("vec").alias("_vec"),
            F.array(*[F.col(c).cast("double") for c in extra]).cast("array<double>").alias("_x"))

    both = side(tokens, "token_idx", token_cols, "_nt", "_nq", "_a", "_b").unionByName(
        side(questions, "t_idx", question_cols, "_nq", "_nt", "_b", "_a"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + out
    fields = [f.split() for f in out.split(",")]
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def run(table: pa.Table) -> pa.Table:
        token = table.column("_token").to_numpy().astype(bool)
        args = []
        for part in (table.filter(pa.array(token)), table.filter(pa.array(~token))):
            args += [part.column("_id").to_numpy(), _matrix(part.column("_vec")), _matrix(part.column("_x"))] if part.num_rows else [None] * 3
        cols = fn(*args) if token.any() and not token.all() else [[] for _ in fields]
        n = len(cols[0])
        head = [pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys]
        return pa.table(head + [pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], keys + [name for name, _ in fields])

    return both.groupBy(*keys, "_a", "_b").applyInArrow(run, schema)


def similarity_rows(tokens: DataFrame, questions: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """(keys, t_idx, token_idx, sim): the whole matrix, a row for each entry."""
    def fn(ids, x, _, q_ids, q, __):
        sim = x @ q.T
        return np.tile(q_ids, len(ids)), np.repeat(ids, len(q_ids)), sim.ravel()

    return tiles(tokens, questions, keys, fn, "t_idx bigint, token_idx bigint, sim double", tile=tile)


def largest_similarity(tokens: DataFrame, questions: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """(keys, token_idx, text_score): the largest product with any question vector."""
    parts = tiles(tokens, questions, keys, lambda ids, x, _, q_ids, q, __: (ids, (x @ q.T).max(axis=1)),
                  "token_idx bigint, text_score double", tile=tile)
    return parts.groupBy(*keys, "token_idx").agg(F.max("text_score").alias("text_score"))


def softmax_states(tokens: DataFrame, questions: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """(keys, t_idx, vec, top, total) of each question vector: the maximum of its
    products over the tokens of its group and the sum of exp(product - top)."""
    def fn(ids, x, _, q_ids, q, __):
        sim = x @ q.T
        top = sim.max(axis=0)
        return q_ids, top, np.exp(sim - top).sum(axis=0)

    # a row for each question vector and token block
    parts = written(tiles(tokens, questions, keys, fn, "t_idx bigint, m double, s double", tile=tile), "softmax-parts")
    top = parts.groupBy(*keys, "t_idx").agg(F.max("m").alias("top"))
    merged = parts.join(top, [*keys, "t_idx"]).groupBy(*keys, "t_idx", "top").agg(
        F.sum(F.col("s") * F.exp(F.col("m") - F.col("top"))).alias("total"))
    return questions.join(merged, [*keys, "t_idx"])


def attention_sums(tokens: DataFrame, questions: DataFrame, keys, tile: int = TILE, states: DataFrame | None = None) -> DataFrame:
    """(keys, token_idx, attention, n_questions): the attention of all question
    vectors (a softmax over the tokens each) that falls on a token, summed."""
    states = softmax_states(tokens, questions, keys, tile) if states is None else states

    def fn(ids, x, _, q_ids, q, state):
        return ids, (np.exp(x @ q.T - state[:, 0]) / state[:, 1]).sum(axis=1), np.full(len(ids), len(q_ids))

    parts = tiles(tokens, states, keys, fn, "token_idx bigint, a double, q bigint", question_cols=("top", "total"), tile=tile)
    return parts.groupBy(*keys, "token_idx").agg(F.sum("a").alias("attention"), F.sum("q").alias("n_questions"))


def attention_entropy(tokens: DataFrame, questions: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """(keys, token_idx, attention, entropy): the summed attention of a token, and
    the entropy of its shares over the question vectors."""
    keys = list(keys)
    tokens = written(tokens.select(*keys, "token_idx", "vec"), "attended-tokens")
    states = written(softmax_states(tokens, questions, keys, tile), "softmax-states")
    sums = written(attention_sums(tokens, questions, keys, tile, states).select(*keys, "token_idx", "attention"), "attention-sums")

    def fn(ids, x, own, q_ids, q, state):
        a = np.exp(x @ q.T - state[:, 0]) / state[:, 1]
        p = np.maximum(a / (own[:, :1] + ENTROPY_EPS), ENTROPY_EPS)
        return ids, -(p * np.log(p)).sum(axis=1)

    parts = tiles(tokens.join(sums, [*keys, "token_idx"]), states, keys, fn, "token_idx bigint, h double",
                  token_cols=("attention",), question_cols=("top", "total"), tile=tile)
    return parts.groupBy(*keys, "token_idx").agg(F.sum("h").alias("entropy")).join(sums, [*keys, "token_idx"])
