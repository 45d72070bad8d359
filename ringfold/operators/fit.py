"""Fitting a sum of terms to every profile at once.

Candidates for the shape parameters of one term are tried side by side: per
candidate the linear parameters of all terms follow exactly, within their bounds,
from sums over the points; the best candidate is kept. The terms take turns, so
candidates grow with the shapes of one term, not of the whole model; each round
the grid is narrowed around the best. The points of a measurement (at most its q
bins) are brought together once, and all later groupings and joins stay there.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import total
from ..functions.lineage import written
from ..functions.skew import attach, parts_for
from .integrate import ID
from .terms import TermSum

# Sum of squares is compared after this rounding, so round-off cannot decide.
SSE_DIGITS = 9
# Weight of a point inside a cut-off range: an uncertainty of 1e6.
CUT_WEIGHT = 1e-12
# Sums (of one candidate and measurement) that one task keeps.
TASK_SUMS = 250_000


def _slots(model: TermSum) -> list[dict]:
    """Every parameter of the model with its place."""
    out = []
    for number, term in enumerate(model.functions):
        for name, p in zip(term.names, term.parameters):
            out.append(
                {
                    "term": number,
                    "name": name,
                    "parameter": p,
                    "linear": name in term.linear,
                    "squared": term.squared and name in term.linear,
                }
            )
    return out


def _weight(x: str, cutoff_ranges) -> Column:
    weight = F.lit(1.0)
    for start, end in cutoff_ranges or []:
        inside = (F.col(x) > float(start)) & (F.col(x) < float(end))
        weight = F.when(inside, CUT_WEIGHT).otherwise(weight)
    return weight


def _offsets(dims: int, grid: int) -> list[tuple[float, ...]]:
    """Grid of offsets in [-1, 1] per shape parameter."""
    line = [2.0 * i / (grid - 1) - 1.0 for i in range(grid)]
    return list(itertools.product(line, repeat=dims))


def _bases(model: TermSum, x: str) -> list[Column]:
    """Basis columns of all linear parameters from the shape columns s0, s1, ..."""
    out, at = [], 0
    for term in model.functions:
        shape = {n: F.col(f"s{at + i}") for i, n in enumerate(term.shape)}
        at += len(term.shape)
        out += term.basis(F.col(x), shape)
    return out


def _sums(rows: DataFrame, m: int, shapes: int, y: str) -> DataFrame:
    aggregates = [F.sum(F.col("_w") * F.col(y) * F.col(y)).alias("yy")]
    for i in range(m):
        aggregates.append(F.sum(F.col("_w") * F.col(f"b{i}") * F.col(y)).alias(f"r{i}"))
        for j in range(i + 1):
            aggregates.append(
                F.sum(F.col("_w") * F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}")
            )
    aggregates += [F.max(f"s{i}").alias(f"s{i}") for i in range(shapes)]
    return rows.groupBy(ID, "cand").agg(*aggregates)


def _free_solution(g: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Solutions of stacked normal equations by triangular factorization. A
    direction without weight of its own gets 0."""
    m = r.shape[1]
    low, pivot, z = np.zeros_like(g), np.zeros_like(r), np.zeros_like(r)
    with np.errstate(all="ignore"):
        for j in range(m):
            own = g[:, j, j] - (low[:, j, :j] ** 2 * pivot[:, :j]).sum(axis=1)
            ok = own > 1e-12 * g[:, j, j]
            pivot[:, j] = np.where(ok, own, 0.0)
            for i in range(j + 1, m):
                top = g[:, i, j] - (low[:, i, :j] * low[:, j, :j] * pivot[:, :j]).sum(axis=1)
                low[:, i, j] = np.where(ok, top / own, 0.0)
            z[:, j] = r[:, j] - (low[:, j, :j] * z[:, :j]).sum(axis=1)
        out = np.zeros_like(r)
        for j in reversed(range(m)):
            rest = (low[:, j + 1 :, j] * out[:, j + 1 :]).sum(axis=1)
            out[:, j] = np.where(pivot[:, j] > 0, z[:, j] / pivot[:, j] - rest, 0.0)
    return out


def bounded_solution(g: np.ndarray, r: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    """The minima of x' g x - 2 r x of stacked problems with lower and upper bounds.

    An active set: some parameters lie at a bound, the others are solved
    freely. A free one that would leave its bounds stops there and is fixed; with
    all inside, a fixed one that the gradient pulls inwards is freed. Each
    step lowers the sum of squares, so no set returns and the search ends at the
    minimum. Rows with values that are not finite give NaN.
    """
    m = len(bounds)
    low, high = (np.array([b[k] for b in bounds], float) for k in (0, 1))
    fine = np.isfinite(g).all(axis=(1, 2)) & np.isfinite(r).all(axis=1)
    out = np.full(r.shape, np.nan)
    out[fine] = _free_solution(g[fine], r[fine])
    todo = np.flatnonzero(fine & ((out < low) | (out > high)).any(axis=1))
    if not len(todo):
        return out
    g, r = g[todo], r[todo]
    x = np.clip(out[todo], low, high)
    fixed = (x == low) | (x == high)
    scale = 1e-12 * np.sqrt(np.einsum("nii->ni", g)) + 1e-300
    done = np.zeros(len(todo), bool)
    steps = 0
    while not done.all() and steps < 50 * (m + 1):
        steps += 1
        at = np.flatnonzero(~done)
        ga, xa, fa = g[at], x[at], fixed[at]
        right = r[at] - np.einsum("nij,nj->ni", ga, np.where(fa, xa, 0.0))
        reduced = np.where(fa[:, :, None] | fa[:, None, :], 0.0, ga) + np.eye(m) * fa[:, :, None]
        goal = np.where(fa, xa, _free_solution(reduced, np.where(fa, xa, right)))
        move = goal - xa
        with np.errstate(all="ignore"):
            room = np.where(move > 0, (high - xa) / move, np.where(move < 0, (low - xa) / move, np.inf))
        room = np.where(fa, np.inf, room)
        share = np.minimum(room.min(axis=1), 1.0)
        new = np.clip(xa + share[:, None] * move, low, high)
        stops = ~fa & (room <= share[:, None]) & (share[:, None] < 1)
        new = np.where(stops, np.where(move > 0, high, low), new)
        fa = fa | stops
        inside = ~stops.any(axis=1)
        pull = r[at] - np.einsum("nij,nj->ni", ga, new)
        size = np.abs(r[at]) + np.einsum("nij,nj->ni", np.abs(ga), np.abs(new))
        inwards = fa & (((new == low) & (pull > 0)) | ((new == high) & (pull < 0))) & (low < high)
        gain = np.where(inwards & (np.abs(pull) > 1e-12 * size), np.abs(pull) / scale[at], 0.0)
        free = inside & (gain.max(axis=1) > 0)
        fa[free, gain.argmax(axis=1)[free]] = False
        x[at], fixed[at] = new, fa
        done[at] = inside & ~free
    for i in np.flatnonzero(~done):  # round-off alone keeps a set from settling
        last = None
        while last is None or np.abs(x[i] - last).max() > 1e-12 * (1 + np.abs(last).max()):
            last = x[i].copy()
            for j in range(m):
                if g[i, j, j] > 0:
                    x[i, j] = np.clip(x[i, j] + (r[i, j] - g[i, j] @ x[i]) / g[i, j, j], low[j], high[j])
    out[todo] = x
    return out


def _solve(sums: DataFrame, bounds: list[tuple[float, float]]) -> DataFrame:
    """Linear parameters a0, a1, ... within their bounds, and ``sse``."""
    m = len(bounds)

    def solve(sums: pa.Array) -> pa.Array:
        flat = sums.flatten().to_numpy(zero_copy_only=False).reshape(-1, m * m + m)
        found = bounded_solution(flat[:, : m * m].reshape(-1, m, m), flat[:, m * m :], bounds)
        ends = np.arange(len(found) + 1, dtype=np.int32) * m
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    products = [F.col(f"g{max(i, j)}_{min(i, j)}") for i in range(m) for j in range(m)]
    given = F.transform(
        F.array(*products, *[F.col(f"r{i}") for i in range(m)]), lambda v: F.coalesce(v, F.lit(float("nan")))
    )
    # said to be nondeterministic, so that it is worked out once
    solved = F.arrow_udf(solve, "array<double>").asNondeterministic()(given)
    df = sums.withColumn("_in", solved).withColumns({f"a{j}": F.get("_in", F.lit(j)) for j in range(m)})
    sse = F.col("yy") - 2 * total([F.col(f"a{i}") * F.col(f"r{i}") for i in range(m)])
    for i in range(m):
        for j in range(i + 1):
            twice = 1.0 if i == j else 2.0
            sse = sse + twice * F.col(f"a{i}") * F.col(f"a{j}") * F.col(f"g{i}_{j}")
    return df.withColumn("sse", F.greatest(sse, F.lit(0.0)))


def _linear_bounds(slots: list[dict]) -> list[tuple[float, float]]:
    out = []
    for s in slots:
        if not s["linear"]:
            continue
        low, high = s["parameter"].min_value, s["parameter"].max_value
        if s["squared"]:
            ends = [low * low, high * high]
            low, high = (0.0 if low <= 0 <= high else min(ends)), max(ends)
        out.append((low, high))
    return out


def fit(
    points: DataFrame,
    model: TermSum,
    x: str = "q",
    y: str = "intensity",
    grid: int = 9,
    rounds: int = 4,
    sweeps: int = 2,
    cutoff_ranges: list[tuple[float, float]] | None = None,
) -> DataFrame:
    """One row per measurement: ``fit_params_all`` in the order of the model,
    ``fit_params_{i}`` per term and ``sse``. Shape parameters need finite bounds.

    In a round each term with shape parameters has its turn (with several such
    terms, ``sweeps`` turns): a grid over its own shapes is tried, the others stay
    as found so far, at first at the initial guess. What was found is one more
    candidate. Then all grids are narrowed. Measurements without a finite result
    are dropped.
    """
    slots = _slots(model)
    shapes = [s for s in slots if not s["linear"]]
    limits = [(s["parameter"].min_value, s["parameter"].max_value) for s in shapes]
    if any(math.isinf(v) for ends in limits for v in ends):
        raise ValueError("shape parameters need finite bounds")
    bounds = _linear_bounds(slots)
    turns = [
        [j for j, s in enumerate(shapes) if s["term"] == term]
        for term in sorted({s["term"] for s in shapes})
    ] or [[]]
    # all that follows is by measurement: one exchange serves every round. A task
    # keeps sums of each candidate of its measurements, so their number is bounded
    found = points.agg(F.approx_count_distinct(ID)).first()[0]
    candidates = max(grid ** len(turn) + 1 for turn in turns)
    rows = (
        points.select(ID, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .withColumn("_w", _weight("_x", cutoff_ranges))
        .repartition(parts_for(points, found * candidates, TASK_SUMS), ID)
    )
    half = [(high - low) / 2 for low, high in limits]
    middle = [(high + low) / 2 for low, high in limits]
    best = None
    for number in range(rounds if shapes else 1):
        for turn in turns * (sweeps if len(turns) > 1 else 1):
            center = {j: F.lit(float(middle[j])) for j in turn} if number == 0 else None
            best = _tried(rows, best, model, shapes, limits, bounds, turn, center, half, grid)
            if shapes:  # one row per measurement; plans stay short however many turns
                best = written(best, "fit")
        half = [h * 2.0 / (grid - 1) for h in half]
    return _named(best, model, slots)


def _tried(rows, best, model, shapes, limits, bounds, turn, center, half, grid) -> DataFrame:
    """The best shapes of each measurement after a grid over those of ``turn``,
    around ``center`` or around what was ``best`` so far."""
    if best is None:
        start = rows.withColumns({f"s{j}": F.lit(float(s["parameter"].value)) for j, s in enumerate(shapes)})
    else:
        start = rows.join(best.select(ID, *[f"s{j}" for j in range(len(shapes))]), ID)
    offsets = _offsets(len(turn), grid)
    # the index of a candidate breaks ties, so it is part of the result; the
    # last one stays where the search was
    candidates = F.array(
        *[
            F.struct(F.lit(i).alias("cand"), *[F.lit(v).alias(f"o{j}") for j, v in zip(turn, o)])
            for i, o in enumerate(offsets)
        ],
        *(
            [F.struct(F.lit(len(offsets)).alias("cand"), *[F.lit(None).cast("double").alias(f"o{j}") for j in turn])]
            if turn
            else []
        ),
    )

    def shape(j: int) -> Column:
        own = F.col(f"s{j}")
        if j not in turn:
            return own
        at = own if center is None else center[j]
        low, high = (F.lit(float(v)) for v in limits[j])
        moved = F.greatest(low, F.least(high, at + F.col(f"_c.o{j}") * half[j]))
        return F.when(F.col(f"_c.o{j}").isNull(), own).otherwise(moved)

    tried = start.withColumn("_c", F.explode(candidates)).select(
        ID, "_x", "_y", "_w", F.col("_c.cand").alias("cand"),
        *[shape(j).alias(f"s{j}") for j in range(len(shapes))],
    )
    tried = tried.withColumns({f"b{i}": b for i, b in enumerate(_bases(model, "_x"))})
    solved = _solve(_sums(tried, len(bounds), len(shapes), "_y"), bounds)
    keep = [f"s{j}" for j in range(len(shapes))]
    keep += [f"a{i}" for i in range(len(bounds))] + ["sse"]
    # candidates without a finite result come last; filtering them before the
    # aggregation would push the whole solution into the filter as well
    none = F.col("sse").isNull() | F.isnan("sse")
    return (
        solved.groupBy(ID)
        .agg(
            F.min_by(
                F.struct(*keep),
                F.struct(none, F.round("sse", SSE_DIGITS), F.col("cand")),
            ).alias("_b")
        )
        .select(ID, "_b.*")
        .filter(F.col("sse").isNotNull() & ~F.isnan("sse"))
    )


def _named(best: DataFrame, model: TermSum, slots: list[dict]) -> DataFrame:
    per_term: list[list[Column]] = [[] for _ in model.functions]
    shape = linear = 0
    for s in slots:
        if s["linear"]:
            value = F.col(f"a{linear}")
            if s["squared"]:
                root = F.sqrt(value)
                value = F.when(root <= s["parameter"].max_value, root).otherwise(-root)
            linear += 1
        else:
            value = F.col(f"s{shape}")
            shape += 1
        per_term[s["term"]].append(value)
    return best.select(
        ID,
        F.array(*[v for values in per_term for v in values]).alias("fit_params_all"),
        *[
            F.array(*values).alias(f"fit_params_{i}")
            for i, values in enumerate(per_term)
        ],
        "sse",
    )


def _param_columns(count: int) -> list[Column]:
    return [F.get("fit_params_all", F.lit(i)) for i in range(count)]


def fitted_curve(
    points: DataFrame, fitted: DataFrame, model: TermSum, x: str = "q"
) -> DataFrame:
    """Points of the fitted measurements with the value of the model."""
    joined = attach(points, fitted.select(ID, "fit_params_all"), [ID], ["pos"])
    params = _param_columns(len(model.initial_guess()))
    return joined.withColumn(
        "fitted_curve", model.produce_function()(F.col(x), *params)
    ).drop("fit_params_all")


def condition(
    points: DataFrame,
    fitted: DataFrame,
    model: TermSum,
    x: str = "q",
    cutoff_ranges: list[tuple[float, float]] | None = None,
) -> DataFrame:
    """Condition number of the parameter covariance: that of the matrix of
    summed products of derivatives (central differences)."""
    count = len(model.initial_guess())
    joined = attach(points, fitted.select(ID, "fit_params_all"), [ID], ["pos"])
    joined = joined.withColumns(
        {f"_p{i}": c for i, c in enumerate(_param_columns(count))}
    ).withColumns(
        {
            f"_h{i}": F.greatest(F.abs(f"_p{i}"), F.lit(1e-3)) * 1e-5
            for i in range(count)
        }
    )
    curve = model.produce_function()
    params = [F.col(f"_p{i}") for i in range(count)]

    def moved(i: int, sign: float) -> Column:
        shifted = list(params)
        shifted[i] = params[i] + sign * F.col(f"_h{i}")
        return curve(F.col(x), *shifted)

    joined = joined.withColumns(
        {
            f"_j{i}": (moved(i, 1.0) - moved(i, -1.0)) / (2 * F.col(f"_h{i}"))
            for i in range(count)
        }
    ).withColumn("_w", _weight(x, cutoff_ranges))
    products = [
        F.sum(F.col("_w") * F.col(f"_j{i}") * F.col(f"_j{j}"))
        for i in range(count)
        for j in range(count)
    ]

    @F.pandas_udf("double")
    def conditioned(flat: pd.Series) -> pd.Series:
        stacked = np.stack([np.asarray(v, dtype=float) for v in flat]) if len(flat) else np.zeros((0, count * count))
        finite = np.isfinite(stacked).all(axis=1)
        out = np.full(len(stacked), np.nan)
        out[finite] = np.linalg.cond(stacked[finite].reshape(-1, count, count))
        return pd.Series(out)

    return (
        joined.groupBy(ID)
        .agg(F.array(*products).alias("_m"))
        .select(ID, conditioned("_m").alias("fit_cond"))
    )
