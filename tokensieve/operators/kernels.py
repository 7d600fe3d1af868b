"""Greedy per-group selection (V2-V5, V13) and the kernels of V9 and V10.

These algorithms are sequential inside one group (each pick depends on
the previous ones), so they run as NumPy kernels over one group at a time
with ``groupBy(keys).applyInArrow``: Spark shuffles the rows by group and
runs groups in parallel; each kernel keeps O(n) running state (never an
n x n matrix).

Groups larger than ``max_group`` rows are not collected into one task. Max-min
selection (V2, V3) and DPP MAP (V13) are done lazily there, many picks a round
(``lazy``). V4 takes an exact distributed path (``iterative_text_guided``) in which every pick is a partial aggregate over all of the
group's rows (``min_by``), the picked row is joined back and the per-row state is
updated; lineage is cut with ``checkpoint()`` into the session's
``spark.checkpoint.dir``.  All paths give the same picks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise
from ..session import ensure_checkpoint_dir, written
from .lazy import DPP_EPS, lazy_dpp, lazy_maxmin

# The diversity penalty of text-guided selection and the
# default largest group handled inside one task.
DIVERSITY_PENALTY = 0.8
MAX_GROUP = 20_000
CHECKPOINT_EVERY = 8
# Nearest rows kept for each row of an even/odd line (V5), and the most products held at once.
NEAREST = 32
NEAREST_BLOCK = 1 << 22


# ----------------------------------------------------------------------------
# NumPy kernels on one group (rows in candidate order)
# ----------------------------------------------------------------------------
def normalise_rows(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(n, eps)[:, None]


def maxmin_diverse(x: np.ndarray, k: int, start: int = 0) -> list[int]:
    """V2/V3: start at row ``start``; repeatedly add the row whose largest
    similarity to the chosen rows is smallest (first row on ties)."""
    n = x.shape[0]
    if n <= k:
        return list(range(n))
    if k <= 0:
        return []
    chosen = [start]
    run = x @ x[start]
    run[start] = np.inf
    for _ in range(k - 1):
        j = int(np.argmin(run))
        if not np.isfinite(run[j]):
            break
        chosen.append(j)
        run = np.maximum(run, x @ x[j])
        run[chosen] = np.inf
    return chosen


def text_guided(x: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """V4: the best score is taken out by setting it to minus infinity, which
    no later penalty (``0.8 * sim(row, pick)``) can bring back."""
    score = np.array(weights, np.float64)
    picks = np.empty(max(0, min(k, len(x))), np.int64)
    for r in range(len(picks)):
        picks[r] = j = score.argmax()
        score[j] = -np.inf
        score -= DIVERSITY_PENALTY * (x @ x[j])
    return picks.tolist()


def _closeness(a: np.ndarray, b: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Largest similarity of each row of ``a`` to any row of ``b``, in blocks."""
    out = np.full(len(a), -np.inf)
    for s in range(0, len(b), rows):
        np.maximum(out, (a @ b[s:s + rows].T).max(axis=1, initial=-np.inf), out=out)
    return out


def _falling(values: np.ndarray) -> np.ndarray:
    """Places by falling value, ties in order and NaN last."""
    order = np.argsort(-values)
    ranked = values[order]
    return order if (ranked[1:] < ranked[:-1]).all() else np.argsort(-values, kind="stable")


def _pair_dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``x[i]`` and ``y[j]``, summed left to right as ``dot`` does."""
    out = np.zeros(len(i))
    for c in range(x.shape[1]):
        out += x[i, c] * y[j, c]
    return out


class _Nearest:
    """The rows ``x`` and the ``NEAREST`` rows of ``alive`` closest to each of those, itself among them.

    Rows are picked by matrix products, in blocks, and ordered by the products
    that count (``_pair_dots``). ``floor`` is the largest of these that a row not on the list may reach.
    """

    def __init__(self, x: np.ndarray, alive: np.ndarray):
        n, k = len(alive), min(NEAREST, len(alive))
        self.x, self.n, self.spent = x, n, 0
        self.eps = 4 * x.shape[1] * np.finfo(np.float64).eps * float(np.einsum("ij,ij->i", x, x).max(initial=0.0))
        self.place = np.full(len(x), -1)  # of a row on the lists
        self.place[alive] = np.arange(n)
        self.rows, self.sims, self.floor = np.empty((k, n), np.int64), np.empty((k, n)), np.full(n, -np.inf)
        own, step = x[alive], max(1, NEAREST_BLOCK // n)
        for s in range(0, n, step):
            sim = own[s:s + step] @ own.T
            at = np.arange(len(sim))
            near = np.argpartition(sim, n - k, axis=1)[:, n - k:]
            exact = _pair_dots(own, np.repeat(at + s, k), own, near.ravel()).reshape(-1, k)
            if k < n:
                self.floor[s:s + step] = np.take_along_axis(sim, near, 1).min(axis=1) + self.eps
            order = np.argsort(-exact, axis=1)
            self.rows[:, s:s + step] = alive[np.take_along_axis(near, order, 1)].T
            self.sims[:, s:s + step] = np.take_along_axis(exact, order, 1).T

    def closest(self, rows: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Largest product of each of ``rows`` with a row for which ``odd`` holds (some do)."""
        out, own = np.full(len(rows), -np.inf), self.place[rows]
        left, at = np.arange(len(rows)), own
        for near, sims in zip(self.rows, self.sims):
            hit = odd[near[at]]
            out[left[hit]] = sims[at[hit]]
            np.logical_not(hit, out=hit)
            left, at = left[hit], at[hit]
            if not len(left):
                break
        unsure = np.flatnonzero(out < self.floor[own])
        if len(unsure):
            out[unsure] = self._searched(rows[unsure], odd)
        return out

    def _searched(self, rows: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """As ``closest``, from all products with the odd rows."""
        self.spent += len(rows)
        held = np.flatnonzero(odd)
        y, out, step = self.x[held], np.empty(len(rows)), max(1, NEAREST_BLOCK // len(held))
        for s in range(0, len(rows), step):
            sim = self.x[rows[s:s + step]] @ y.T
            i, j = np.nonzero(sim >= sim.max(axis=1)[:, None] - self.eps)  # every row has one
            out[s:s + step] = np.maximum.reduceat(_pair_dots(self.x, rows[s + i], y, j), np.searchsorted(i, np.arange(len(sim))))
        return out


def dedup_even_odd(x: np.ndarray, target: int, batch: int = 2) -> list[int]:
    """V5: each round shortens the line by ``batch`` rows at most, from its
    even places: those come first by falling closeness to the odd places (ties
    in line order) without the closest, then the odd places as they stand.

    A row's closeness is read off a list of its nearest rows: the first of them
    in an odd place. About every other row is in one, so a round costs a few
    looks a row; a row whose list names none is compared with all odd rows.
    Lists are kept per distinct row, and made anew when half of their rows are
    gone or many were of no use. A row with a NaN is close to none, and in an odd place
    leaves every closeness undefined: the line order then stands. Infinite values
    are compared row by row each round.
    """
    line, endless = np.arange(len(x)), np.isinf(x).any()
    broken = np.isnan(x).any(axis=1)
    kinds, kind = np.unique(np.where(broken[:, None], 0.0, x) + 0.0, axis=0, return_inverse=True)
    kind = kind.ravel()
    lists, alive = None, np.bincount(kind[~broken], minlength=len(kinds))
    for size in range(len(x), max(target, 0), -batch):
        even, odd = line[0::2], line[1::2]
        if endless or not len(odd):
            close = _closeness(x[even], x[odd])
        else:
            close = np.full(len(even), np.nan)
            if not broken[odd].any():
                if lists is None or 2 * np.count_nonzero(alive) < lists.n or lists.spent > lists.n:
                    lists = _Nearest(kinds, np.flatnonzero(alive))
                odds = np.zeros(len(kinds), bool)
                odds[kind[odd]] = True
                whole = np.flatnonzero(~broken[even])
                close[whole] = lists.closest(kind[even[whole]], odds)
        drop, falling = min(batch, size - target), _falling(close)
        gone = even[falling[:drop]]
        np.subtract.at(alive, kind[gone[~broken[gone]]], 1)
        line = np.r_[even[falling[drop:]], odd]
    return line.tolist()


def dpp_map(x: np.ndarray, rel: np.ndarray, k: int) -> list[int]:
    """Greedy MAP of a DPP with kernel ``r_i <x_i, x_j> r_j`` (rows of
    ``x`` unit length); Cholesky-style incremental update, O(n k) state."""
    n = x.shape[0]
    k = min(k, n)
    c = np.zeros((k, n))
    d2 = rel * rel * np.einsum("ij,ij->i", x, x)
    out = []
    for i in range(k):
        j = int(np.argmax(d2))
        if not np.isfinite(d2[j]):
            break
        out.append(j)
        lrow = rel[j] * (x @ x[j]) * rel
        e = (lrow - c[:i, j] @ c[:i, :]) / np.sqrt(max(d2[j], DPP_EPS))
        c[i] = e
        d2 = d2 - e * e
        d2[out] = -np.inf
    return out


def nearest_centre(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Index of each row's nearest centre, from |c|^2 - 2 x.c in row blocks."""
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    return np.concatenate([(half - x[s:s + rows] @ centres.T).argmin(axis=1) for s in range(0, len(x), rows)] or [np.empty(0, np.int64)])


def kmeans_lloyd(x: np.ndarray, k: int, init: np.ndarray, max_iters: int = 10, atol: float = 1e-4):
    """Lloyd's rule from the rows ``init``. Centre sums and sizes are
    scatter-added, so a round costs two passes and no k-fold loop. A centre
    without rows stays; a round that moves no centre by ``atol`` ends it and
    is not taken."""
    centres = np.array(x[init[:k]], np.float64)
    own = nearest_centre(x, centres)
    for r in range(max_iters):
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        moved = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        if np.allclose(centres, moved, atol=atol, rtol=1e-5):
            break
        centres = moved
        if r + 1 < max_iters:
            own = nearest_centre(x, centres)
    return centres, own


def farthest_first(points: np.ndarray, k: int, start: int) -> np.ndarray:
    """``k`` points, each the farthest (first on ties) from those before it;
    the running distance of every point to the chosen set is all the state."""
    gap = np.full(len(points), np.inf)
    chosen = [start]
    while len(chosen) < min(k, len(points)):
        np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1), out=gap)
        gap[chosen] = -1.0
        chosen.append(int(gap.argmax()))
    return np.array(chosen)


def cluster_representatives(x: np.ndarray, k: int, init: np.ndarray) -> list[int]:
    """V9: ``min(2k, n)`` clusters, their centres taken farthest-first from the
    one nearest the mean; each centre is stood for by its own nearest row."""
    if k <= 0 or not len(x):
        return []
    centres, own = kmeans_lloyd(x, min(2 * k, len(x)), init)
    order = farthest_first(centres, k, int(((centres - x.mean(axis=0)) ** 2).sum(axis=1).argmin()))
    spread = ((x - centres[own]) ** 2).sum(axis=1)
    rows = np.lexsort((np.arange(len(x)), spread, own))  # by cluster, nearest first
    held, first = np.unique(own[rows], return_index=True)
    nearest = dict(zip(held.tolist(), rows[first].tolist()))
    return [nearest[c] for c in order.tolist() if c in nearest]


# ----------------------------------------------------------------------------
# Spark wrappers
# ----------------------------------------------------------------------------
def _vec_matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(arr)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _out_schema(df: DataFrame, keys) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {types[k]}" for k in keys) + ", token_idx bigint, pick_rank int"


def run_grouped(df: DataFrame, keys, fn: Callable, cols=("vec",), k_col: str = "k",
                order_col: str = "token_idx") -> DataFrame:
    """Apply ``fn(matrix, extra_columns..., k) -> picked row positions`` to
    every group (rows sorted by ``order_col``, then ``token_idx``); emit
    (keys, token_idx, pick_rank)."""
    keys = list(keys)
    use = [*keys, "token_idx", *cols, k_col] + ([order_col] if order_col != "token_idx" else [])
    schema = _out_schema(df, keys)

    def apply(table: pa.Table) -> pa.Table:
        sort_keys = [(order_col, "ascending")] + ([("token_idx", "ascending")] if order_col != "token_idx" else [])
        table = table.sort_by(sort_keys)
        n = table.num_rows
        tok = table.column("token_idx").to_numpy()
        kv = int(table.column(k_col)[0].as_py()) if n else 0
        args = []
        for c in cols:
            col = table.column(c)
            args.append(_vec_matrix(col) if pa.types.is_list(col.type) else col.to_numpy().astype(np.float64))
        picks = fn(*args, kv) if n else []
        out = {k: pa.array([table.column(k)[0].as_py()] * len(picks), table.schema.field(k).type) for k in keys}
        out["token_idx"] = pa.array(tok[picks] if len(picks) else [], pa.int64())
        out["pick_rank"] = pa.array(np.arange(len(picks), dtype=np.int32))
        return pa.table(out)

    return df.select(*use).groupBy(*keys).applyInArrow(apply, schema)


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir``.  The input is
    persisted first so the eager count and the checkpoint write compute it
    once (a Python kernel is not re-run), then released."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist(blocking=False)


def materialise(df: DataFrame) -> DataFrame:
    """Write a selection (ids only) to the session's checkpoint folder once,
    so a Python kernel feeding several consumers runs once and its result
    survives executor loss; the partitioning is kept for later joins."""
    return _checkpoint(df)


def _iterate(df: DataFrame, keys, state: dict, carry, order, update) -> DataFrame:
    """Generic exact distributed greedy loop over all groups at once.

    ``state``: initial per-row state columns; ``order()``: the struct a
    pick minimises (``min_by``, partial before the shuffle); ``carry``: row
    columns the pick hands to every row of its group; ``update()``: new
    state expressions, reading the pick as ``_p.<col>``.
    """
    keys = list(keys)
    st = df.select(*keys, "token_idx", "k", *[c for c in carry if c not in state],
                   *[e.alias(c) for c, e in state.items()])
    sizes = st.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    st = st.join(sizes, keys).withColumn("pick_rank", F.lit(None).cast("int"))
    rounds = st.agg(F.max(F.least("_n", "k"))).first()[0] or 0
    st = _checkpoint(st)
    for r in range(int(rounds)):
        active = st.where(F.col("pick_rank").isNull() & (F.col("k") > r))
        pick = active.groupBy(*keys).agg(F.min_by(F.struct("token_idx", *carry), order()).alias("_p"))
        j = st.join(pick, keys, "left")
        has = F.col("_p").isNotNull()
        upd = update()
        cols = []
        for c in st.columns:
            if c == "pick_rank":
                hit = has & F.col("pick_rank").isNull() & (F.col("token_idx") == F.col("_p.token_idx"))
                cols.append(F.when(hit, F.lit(r)).otherwise(F.col("pick_rank")).alias(c))
            elif c in upd:
                cols.append(F.when(has, upd[c]).otherwise(F.col(c)).alias(c))
            else:
                cols.append(F.col(c))
        st = j.select(*cols)
        if (r + 1) % CHECKPOINT_EVERY == 0:
            st = _checkpoint(st)
    return st.where(F.col("pick_rank").isNotNull()).select(*keys, "token_idx", "pick_rank")


def iterative_text_guided(df: DataFrame, keys, weight_col: str = "weight") -> DataFrame:
    """Exact distributed V4: state = current score."""
    def order():
        return F.struct(-F.col("_s"), F.col("token_idx"))

    def update():
        return {"_s": F.col("_s") - F.lit(DIVERSITY_PENALTY) * dot("vec", "_p.vec")}

    return _iterate(df, keys, {"_s": F.col(weight_col).cast("double")}, ["vec"], order, update)


def largest_group(df: DataFrame, keys) -> int:
    """Row count of the largest group (a partial aggregate; one small action)."""
    r = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return int(r or 0)


def dispatch_by_size(df: DataFrame, keys, small: Callable[[DataFrame], DataFrame],
                     large: Callable[[DataFrame], DataFrame], max_group: int = MAX_GROUP,
                     largest: int | None = None) -> DataFrame:
    """Run ``small`` on groups up to ``max_group`` rows (one task each) and
    ``large`` (distributed, exact) on the rest.  ``largest`` (an upper bound
    of the group size known to the caller) skips the size check. The names of
    large groups, one for ``max_group`` rows at most, are broadcast, so the
    rows are not shuffled to be told apart; rows of a null key drop out."""
    keys = list(keys)
    if largest is not None and largest <= max_group:
        return small(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gn"))
    hot = sizes.where(F.col("_gn") > max_group).select(*keys)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    if largest is None and hot.isEmpty():
        return small(df)
    small_out = small(df.join(F.broadcast(hot), keys, "left_anti"))
    big = df.join(F.broadcast(hot), keys).select(*df.columns)
    return small_out.unionByName(large(big))


# ----------------------------------------------------------------------------
# Public operators (whole group = candidate set)
# ----------------------------------------------------------------------------
def _with_k(df: DataFrame, k) -> DataFrame:
    return df.withColumn("k", F.lit(int(k)) if isinstance(k, int) else F.col(k))


def diverse_maxmin(df: DataFrame, keys, k, normalise: bool = True, max_group: int = MAX_GROUP,
                   largest: int | None = None) -> DataFrame:
    """V2 per group; rows in ``token_idx`` order, start at the first row."""
    d = _with_k(df, k)
    if normalise:
        d = d.withColumn("vec", l2_normalise("vec"))
    return maxmin(d, keys, max_group=max_group, largest=largest)


def diverse_maxmin_seeded(df: DataFrame, keys, k, seed: int = 42, normalise: bool = True, max_group: int = MAX_GROUP,
                          largest: int | None = None) -> DataFrame:
    """V3: as V2 but the first row is the one with the smallest seeded
    uniform of (seed, group, token)."""
    from ..functions.vectors import uniform
    d = _with_k(df, k).withColumn("_u", uniform(seed, *[F.col(c) for c in keys], F.col("token_idx")))
    if normalise:
        d = d.withColumn("vec", l2_normalise("vec"))
    return maxmin(d, keys, "_u", max_group=max_group, largest=largest)


def maxmin(df: DataFrame, keys, start_col: str | None = None, order_col: str = "token_idx", max_group: int = MAX_GROUP,
           largest: int | None = None) -> DataFrame:
    """``k`` (a column) max-min picks a group, in ``order_col`` order on ties; the
    first row is that of least ``start_col``, or the first in order."""
    def small(x):
        if start_col is None:
            return run_grouped(x, keys, lambda m, kk: maxmin_diverse(m, kk, 0), order_col=order_col)
        return run_grouped(x, keys, lambda m, u, kk: maxmin_diverse(m, kk, int(np.argmin(u))), cols=("vec", start_col), order_col=order_col)

    return dispatch_by_size(df, keys, small, lambda x: lazy_maxmin(x, keys, order_col, start_col), max_group, largest)


def diverse_text_guided(df: DataFrame, keys, k, weight_col: str = "weight", normalise: bool = True,
                        max_group: int = MAX_GROUP, largest: int | None = None) -> DataFrame:
    """V4 per group with per-row starting weights."""
    d = _with_k(df, k)
    if normalise:
        d = d.withColumn("vec", l2_normalise("vec"))
    return dispatch_by_size(
        d, keys, lambda x: run_grouped(x, keys, lambda m, w, kk: text_guided(m, w, kk), cols=("vec", weight_col)),
        lambda x: iterative_text_guided(x, keys, weight_col), max_group, largest)


def dedup_tokens(df: DataFrame, keys, target, normalise: bool = True) -> DataFrame:
    """V5 per group (``pick_rank`` = survivor order)."""
    d = _with_k(df, target)
    if normalise:
        d = d.withColumn("vec", l2_normalise("vec"))
    return run_grouped(d, keys, lambda m, kk: dedup_even_odd(m, kk))


def dpp_select(df: DataFrame, keys, k, rel_col: str = "relevance", max_group: int = MAX_GROUP,
               largest: int | None = None) -> DataFrame:
    """V13 per group; ``vec`` is L2-normalised here."""
    d = _with_k(df, k).withColumn("vec", l2_normalise("vec"))
    return dispatch_by_size(
        d, keys, lambda x: run_grouped(x, keys, lambda m, r, kk: dpp_map(m, r, kk), cols=("vec", rel_col)),
        lambda x: lazy_dpp(x, keys, rel_col), max_group, largest)


# ----------------------------------------------------------------------------
# Within-group similarities, summed up per token and as a row for each pair
# ----------------------------------------------------------------------------
# Rows of either side whose products are held at once.
PAIR_BLOCK = 1024
# Rows of either side whose pairs one task returns, a block after the other.
PAIR_TILE = 4096


def _block_summary(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray):
    """For each row of x: max and sum of similarity to rows of y with another id."""
    mx = np.full(x.shape[0], -np.inf)
    sm = np.zeros(x.shape[0])
    cnt = np.zeros(x.shape[0], dtype=np.int64)
    for r in range(0, x.shape[0], PAIR_BLOCK):
        own = slice(r, r + PAIR_BLOCK)
        for s in range(0, y.shape[0], PAIR_BLOCK):
            sim = x[own] @ y[s:s + PAIR_BLOCK].T
            same = x_ids[own, None] == y_ids[None, s:s + PAIR_BLOCK]
            sim[same] = 0.0
            sm[own] += sim.sum(axis=1)
            cnt[own] += sim.shape[1] - same.sum(axis=1)
            sim[same] = -np.inf
            np.maximum(mx[own], sim.max(axis=1, initial=-np.inf), out=mx[own])
    return mx, sm, cnt


def pairwise_summary(df: DataFrame, keys, max_group: int = MAX_GROUP, tile: int = 16_384) -> DataFrame:
    """Cosine similarity of every token to every other token of its group,
    reduced per ``token_idx`` to ``max_sim`` and ``mean_sim``.

    Groups up to ``max_group`` rows: one blocked NumPy pass per group.
    Larger groups: tokens are hashed into tiles of about ``tile`` rows and
    every (tile, tile) block is one task, so no task holds more than two
    tiles. Partial (max, sum, count) per token are then aggregated. Either way
    the products of ``PAIR_BLOCK`` by ``PAIR_BLOCK`` rows are held at once. A
    token whose vector is null takes no part.
    """
    keys = list(keys)
    d = df.where(F.col("vec").isNotNull() & F.col("token_idx").isNotNull()).select(*keys, "token_idx", l2_normalise("vec").alias("vec"))
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", token_idx bigint, max_sim double, sum_sim double, n_pairs bigint"

    def whole(table: pa.Table) -> pa.Table:
        x = _vec_matrix(table.column("vec"))
        ids = table.column("token_idx").to_numpy()
        mx, sm, cnt = _block_summary(x, x, ids, ids)
        return _summary_table(table, keys, ids, mx, sm, cnt)

    def block(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy(zero_copy_only=False)
        left = table.filter(pa.array(side == "L"))
        right = table.filter(pa.array(side == "R"))
        lx, rx = _vec_matrix(left.column("vec")), _vec_matrix(right.column("vec"))
        lids, rids = left.column("token_idx").to_numpy(), right.column("token_idx").to_numpy()
        if left.num_rows == 0 or right.num_rows == 0:
            return _summary_table(left, keys, lids, np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64))
        mx, sm, cnt = _block_summary(lx, rx, lids, rids)
        return _summary_table(left, keys, lids, mx, sm, cnt)

    def small(x: DataFrame) -> DataFrame:
        return x.groupBy(*keys).applyInArrow(whole, schema)

    def large(x: DataFrame) -> DataFrame:
        return _paired_tiles(x, keys, ["token_idx", "vec"], tile).groupBy(*keys, "_a", "_b").applyInArrow(block, schema)

    parts = dispatch_by_size(d, keys, small, large, max_group)
    out = parts.groupBy(*keys, "token_idx").agg(F.max("max_sim").alias("max_sim"), F.sum("sum_sim").alias("sum_sim"), F.sum("n_pairs").alias("n_pairs"))
    return out.where(F.col("n_pairs") > 0).select(*keys, "token_idx", "max_sim",
                                                 (F.col("sum_sim") / F.col("n_pairs")).alias("mean_sim"))


def _paired_tiles(x: DataFrame, keys: list, cols: list, tile: int) -> DataFrame:
    """The rows of large groups, hashed into tiles of about ``tile`` rows, on either side (``_side``) of
    every block (``_a``, ``_b``) that their tile is in."""
    sized = x.join(F.broadcast(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), keys)
    nt = F.ceil(F.col("_n") / F.lit(tile)).cast("int")
    t = sized.withColumn("_nt", nt).withColumn("_tile", F.pmod(F.xxhash64("token_idx"), F.col("_nt")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nt") - 1))
    lft = t.select(*keys, *cols, F.col("_tile").alias("_a"), other.alias("_b"), F.lit("L").alias("_side"))
    rgt = t.select(*keys, *cols, other.alias("_a"), F.col("_tile").alias("_b"), F.lit("R").alias("_side"))
    return lft.unionByName(rgt)


def pairwise_rows(df: DataFrame, summary: DataFrame, keys, tile: int = PAIR_TILE) -> DataFrame:
    """Every two tokens of a group: (keys, token_idx, other_idx, sim, max_sim, mean_sim), a row for each
    ordered pair of rows with different ``token_idx``. ``sim`` is their cosine similarity, null where a
    vector is; ``summary`` has the largest and the mean of each token, as from ``pairwise_summary``.

    Groups up to ``tile`` rows are one task each; larger ones are hashed into tiles, and every (tile,
    tile) block is one task. A task returns the pairs of ``PAIR_BLOCK`` by ``PAIR_BLOCK`` rows at once.
    """
    keys = list(keys)
    d = df.where(F.col("token_idx").isNotNull()).select(*keys, "token_idx", l2_normalise("vec").alias("vec"))
    d = written(d.join(summary, [*keys, "token_idx"], "left").select(*d.columns, "max_sim", "mean_sim"), "pair-tokens")
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", token_idx bigint, other_idx bigint, sim double, max_sim double, mean_sim double"
    names = [*keys, "token_idx", "other_idx", "sim", "max_sim", "mean_sim"]

    def known(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors (zeros for null) and which are not null."""
        vec, there = table.column("vec").combine_chunks(), table.column("vec").is_valid().to_numpy(zero_copy_only=False)
        own = _vec_matrix(vec.drop_null())
        x = np.zeros((len(vec), own.shape[1]))
        x[there] = own
        return table.column("token_idx").to_numpy(), x, there

    def blocks(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x, there = known(left)
        other_ids, y, other_there = known(right)
        if not there.any() or not other_there.any():
            x, y = np.zeros((len(ids), 1)), np.zeros((len(other_ids), 1))
        for r in range(0, len(ids), PAIR_BLOCK):
            own = left.slice(r, PAIR_BLOCK)
            for s in range(0, len(other_ids), PAIR_BLOCK):
                a, b = ids[r:r + PAIR_BLOCK], other_ids[s:s + PAIR_BLOCK]
                i, j = np.nonzero(a[:, None] != b[None, :])
                if not len(i):
                    continue
                sim = (x[r:r + PAIR_BLOCK] @ y[s:s + PAIR_BLOCK].T)[i, j]
                unknown = ~(there[r:r + PAIR_BLOCK][i] & other_there[s:s + PAIR_BLOCK][j])
                at = pa.array(i)
                yield pa.record_batch([*(pa.repeat(left.column(k)[0], len(i)) for k in keys), pa.array(a[i]), pa.array(b[j]),
                                       pa.array(sim, mask=unknown), *(own.column(c).combine_chunks().take(at) for c in ("max_sim", "mean_sim"))], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        yield from blocks(table, table)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("_side").to_numpy(zero_copy_only=False)
        yield from blocks(table.filter(pa.array(side == "L")), table.filter(pa.array(side == "R")))

    def small(x: DataFrame) -> DataFrame:
        return x.groupBy(*keys).applyInArrow(whole, schema)

    def large(x: DataFrame) -> DataFrame:
        return _paired_tiles(x, keys, d.columns[len(keys):], tile).groupBy(*keys, "_a", "_b").applyInArrow(block, schema)

    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return dispatch_by_size(d, keys, small, large, tile)


def _summary_table(table, keys, ids, mx, sm, cnt) -> pa.Table:
    n = len(ids)
    out = {c: pa.array([table.column(c)[0].as_py()] * n if n else [], table.schema.field(c).type) for c in keys}
    out["token_idx"] = pa.array(ids, pa.int64())
    out["max_sim"] = pa.array(mx, pa.float64())
    out["sum_sim"] = pa.array(sm, pa.float64())
    out["n_pairs"] = pa.array(cnt, pa.int64())
    return pa.table(out)
