"""Lazy greedy selection of very large groups: max-min (V2, V3, diverse fills) and DPP MAP.

Both rules pick the token of least value, where picks can only raise the values of the others:
the largest similarity to the picks so far, or the negative of what is left of a
token's squared length once the directions of the picks are taken out. So a value
that is not up to date is a lower bound. Tokens are dealt once to blocks, written
as one row a block. In a round every block brings its values up to date with the
last picks and hands out its ``AHEAD`` smallest (value, order, token) with the next one as
its bound. No token outside the handed-out ones comes before the least bound
of the group; so one task that has at most ``CANDIDATES`` tokens of a group takes
pick after pick, as long as the smallest among them stays before that bound.
Each such pick is the one that the step-by-step rule makes. A round proves many
picks and moves only values, candidates and picks, never a group's vectors through one task.

For DPP MAP a token's vector is its relevance times its unit vector, and a pick
hands on its direction, orthogonal to those before it: no list of coefficients
grows in the rows. Once the picks span all dimensions, what is left is rounding,
and the further picks are as arbitrary as they are step by step.

Defined results: ties go to the smaller order value, then to the smaller token; a group
with at most ``k`` tokens is kept whole, by max-min in order, by DPP as picked; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK, AHEAD, CANDIDATES = 1024, 64, 4096
# Fixed value: the pivot guard of the DPP update.
DPP_EPS = 1e-12
LAST = (np.inf, np.iinfo(np.int64).max, np.iinfo(np.int64).max)


def _matrix(vecs: pa.Array) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def _types(df: DataFrame, keys) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def _blocks(rows: DataFrame, keys) -> DataFrame:
    """(keys, b, ids, ords, vecs), tokens of a block in order."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_n"))
    dealt = rows.join(sizes, keys).withColumn("b", F.pmod(F.xxhash64("token_idx"), F.col("_n")).cast("int"))
    packed = dealt.groupBy(*keys, "b").agg(F.sort_array(F.collect_list(F.struct("_ord", "token_idx", "vec"))).alias("_r"))
    return written(packed.select(*keys, "b", F.col("_r.token_idx").alias("ids"), F.col("_r._ord").alias("ords"), F.col("_r.vec").alias("vecs")), "greedy-blocks")


def _packed(picks: DataFrame, keys) -> DataFrame:
    return picks.groupBy(*keys).agg(F.collect_list("token_idx").alias("new_ids"), F.collect_list("vec").alias("new_vecs"))


def _risen(now: np.ndarray | None, x: np.ndarray, p: np.ndarray, dpp: bool) -> np.ndarray:
    """Values of the rows ``x`` after the picks ``p``; ``now``: those before, if any."""
    if dpp:
        now = -np.einsum("ij,ij->i", x, x) if now is None else now
        return now + ((x @ p.T) ** 2).sum(axis=1)
    new = (x @ p.T).max(axis=1)
    return new if now is None else np.maximum(now, new)


def _updated(blocks: DataFrame, values: DataFrame | None, picks: DataFrame, active: DataFrame, keys, dpp: bool) -> DataFrame:
    """One row a block (its values) and its candidate rows, after the round's picks."""
    d = blocks.join(active, keys, "left_semi").join(_packed(picks, keys), keys, "left")
    d = d.join(values, [*keys, "b"]) if values is not None else d.withColumn("run", F.lit(None).cast("array<double>"))
    names = ["b", "run", "token_idx", "_ord", "_run", "vec", "b_run", "b_ord", "b_id"]
    kinds = [pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for i, key in enumerate(key_values):
                ids, ords = (batch.column(c)[i].values.to_numpy() for c in ("ids", "ords"))
                vecs, new, before = (batch.column(c)[i] for c in ("vecs", "new_vecs", "run"))
                x = _matrix(vecs.values)
                p = _matrix(new.values) if new.is_valid else np.empty((0, x.shape[1]))
                now = _risen(before.values.to_numpy() if before.is_valid else None, x, p, dpp)
                if new.is_valid:
                    now[np.isin(ids, batch.column("new_ids")[i].values.to_numpy())] = np.inf
                order = np.argsort(now, kind="stable")[:AHEAD + 1]  # rows stand in (order, token)
                order = order[np.isfinite(now[order])]
                bound = LAST
                if len(order) > AHEAD:
                    bound = (now[order[-1]], ords[order[-1]], ids[order[-1]])
                    order = order[:-1]
                n = len(order)
                cols = [[batch.column("b")[i].as_py()] + [None] * n, [now] + [None] * n, [None, *ids[order]], [None, *ords[order]],
                        [None, *now[order]], [None, *x[order]], *([None] + [v] * n for v in bound)]
                head = [pa.array([v] * (n + 1), batch.schema.field(k).type) for k, v in zip(keys, key)]
                yield pa.record_batch(head + [pa.array(c, kind) for c, kind in zip(cols, kinds)], [*keys, *names])

    out = "b int, run array<double>, token_idx bigint, _ord bigint, _run double, vec array<double>, b_run double, b_ord bigint, b_id bigint"
    return written(d.mapInArrow(run, f"{_types(blocks, keys)}, {out}"), "greedy-values")


def _nearest_first(x: np.ndarray, run: np.ndarray, _, before) -> Iterator[tuple[int, np.ndarray]]:
    """Max-min picks (row, vector) as long as ``before(row, value)`` holds."""
    run, taken = run.copy(), []
    while True:
        j = int(run.argmin())
        if not before(j, run[j]):
            return
        taken.append(j)
        yield j, x[j]
        run = np.maximum(run, x @ x[j])
        run[taken] = np.inf


def _longest_first(x: np.ndarray, run: np.ndarray, done: np.ndarray, before) -> Iterator[tuple[int, np.ndarray]]:
    """DPP picks (row, direction) as long as ``before(row, value)`` holds; ``done``: the directions so far."""
    left, run, taken = x - (x @ done.T) @ done, run.copy(), []
    while True:
        j = int(run.argmin())
        if not before(j, run[j]):
            return
        taken.append(j)
        direction = left[j] / np.sqrt(max(-run[j], DPP_EPS))
        yield j, direction
        e = left @ direction
        run = run + e * e
        left = left - np.outer(e, direction)
        run[taken] = np.inf


def _proved(candidates: DataFrame, progress: DataFrame, done: DataFrame, keys, dpp: bool) -> DataFrame:
    """(keys, token_idx, vec, pick_rank): the picks that the candidates of each group prove."""
    bound = candidates.groupBy(*keys).agg(F.min(F.struct("b_run", "b_ord", "b_id")).alias("_bound"))
    own = F.struct(F.col("_run").alias("b_run"), F.col("_ord").alias("b_ord"), F.col("token_idx").alias("b_id"))
    near = candidates.join(bound, keys).where(own < F.col("_bound"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_run", "_ord", "token_idx"))
    short = near.withColumn("_place", place).where(F.col("_place") <= CANDIDATES + 1) \
        .select(*keys, "token_idx", "_ord", "_run", "vec", "_place", "_bound")
    if dpp:  # the directions so far, told apart by their place 0
        short = short.unionByName(done.select(*keys, "token_idx", "vec", F.lit(0).alias("_place")), allowMissingColumns=True)
    picks_of = _longest_first if dpp else _nearest_first

    def simulate(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_ord", "ascending"), ("token_idx", "ascending")])
        place = table.column("_place").to_numpy()
        old, table = table.filter(pa.array(place == 0)), table.filter(pa.array(place > 0))
        picks, vecs = [], []
        if table.num_rows:
            place = place[place > 0]
            limit = tuple(table.column("_bound")[0].as_py().values())
            run, ords, ids = (table.column(c).to_numpy() for c in ("_run", "_ord", "token_idx"))
            if table.num_rows > CANDIDATES:
                last = int(table.column("_place").to_numpy().argmax())
                limit = (run[last], ords[last], ids[last])
            x = _matrix(table.column("vec").combine_chunks())
            seen = _matrix(old.column("vec").combine_chunks()) if old.num_rows else np.empty((0, x.shape[1]))
            left = table.column("k")[0].as_py() - table.column("done")[0].as_py()
            proved = picks_of(x, run, seen, lambda j, v: len(picks) < left and np.isfinite(v) and (v, ords[j], ids[j]) < limit)
            for j, vec in proved:
                picks.append(j)
                vecs.append(vec)
        head = [pa.array([table.column(k)[0].as_py()] * len(picks), table.schema.field(k).type) for k in keys]
        rank = np.arange(len(picks)) + (table.column("done")[0].as_py() if picks else 0)
        return pa.table(head + [table.column("token_idx").take(pa.array(picks, pa.int64())), pa.array(vecs, pa.list_(pa.float64())), pa.array(rank, pa.int32())],
                        [*keys, "token_idx", "vec", "pick_rank"])

    return short.join(progress, keys).groupBy(*keys).applyInArrow(simulate, f"{_types(candidates, keys)}, token_idx bigint, vec array<double>, pick_rank int")


def lazy_maxmin(df: DataFrame, keys, order_col: str = "token_idx", start_col: str | None = None) -> DataFrame:
    """(keys, token_idx, pick_rank) of ``k`` (a column) max-min picks a group; the
    first is the one of least ``start_col`` (``order_col`` unless given)."""
    return lazy_rounds(df, keys, order_col, start_col)[0]


def lazy_rounds(df: DataFrame, keys, order_col: str = "token_idx", start_col: str | None = None) -> tuple[DataFrame, int]:
    """The picks, and the number of rounds they took."""
    keys = list(keys)
    rows = df.select(*keys, F.col("token_idx").cast("bigint").alias("token_idx"), F.col(order_col).cast("bigint").alias("_ord"), "vec", "k",
                     F.col(start_col or order_col).alias("_start"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("k").cast("int").alias("k"))
    whole = rows.drop("k").join(sizes.where("n <= k"), keys)
    kept = whole.withColumn("pick_rank", (F.row_number().over(Window.partitionBy(*keys).orderBy("_ord", "token_idx")) - 1).cast("int"))
    rest = rows.drop("k").join(sizes.where("n > k and k > 0"), keys)
    first = rest.groupBy(*keys).agg(F.min_by(F.struct("token_idx", "vec"), F.struct("_start", "_ord", "token_idx")).alias("_p"))
    first = written(first.select(*keys, "_p.token_idx", "_p.vec", F.lit(0).alias("pick_rank")), "greedy-picks")
    picks, rounds = _rounds(rest, first, sizes.where("n > k and k > 0").select(*keys, "k"), keys, dpp=False)
    return kept.select(*keys, "token_idx", "pick_rank").unionByName(picks), rounds


def lazy_dpp(df: DataFrame, keys, rel_col: str = "relevance") -> DataFrame:
    """(keys, token_idx, pick_rank) of ``k`` (a column) DPP MAP picks a group (unit ``vec``)."""
    keys = list(keys)
    token = F.col("token_idx").cast("bigint")
    rows = df.select(*keys, token.alias("token_idx"), token.alias("_ord"), F.transform("vec", lambda x: x * F.col(rel_col).cast("double")).alias("vec"), "k")
    goal = rows.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.max("k")).cast("int").alias("k")).where("k > 0")
    none = rows.select(*keys, "token_idx", "vec", F.lit(0).alias("pick_rank")).limit(0)
    return _rounds(rows.drop("k"), none, written(goal, "greedy-goals"), keys, dpp=True)[0]


def _rounds(rows: DataFrame, first: DataFrame, goal: DataFrame, keys, dpp: bool) -> tuple[DataFrame, int]:
    """(keys, token_idx, pick_rank) of ``goal``'s ``k`` picks a group, after the picks ``first``; the rounds."""
    blocks = _blocks(rows, keys)
    picks, all_picks, values, rounds = first, first, None, 0
    while True:
        sizes = all_picks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("done"))
        progress = goal.join(sizes, keys, "left").fillna(0, ["done"]).where("done < k")
        if progress.isEmpty():
            break
        state = _updated(blocks, values, picks, progress, keys, dpp)
        values = state.where("b is not null").select(*keys, "b", "run")
        picks = written(_proved(state.where("b is null").drop("b", "run"), progress, all_picks, keys, dpp), "greedy-picks")
        if picks.isEmpty():  # nothing finite is left
            break
        all_picks = written(all_picks.unionByName(picks), "greedy-picks") if rounds % 16 == 15 else all_picks.unionByName(picks)
        rounds += 1
    return all_picks.select(*keys, "token_idx", "pick_rank"), rounds
