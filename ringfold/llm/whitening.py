"""Whitening of embeddings by a factorized scatter.

Entries become whole numbers first, so sums and products are exact in any order:
each task centres its vectors at the rounded mean, multiplies them and hands on
one small matrix; their sum, less the square of what rounding left, is the
centred scatter without any error. The covariance is factorized on the driver,
where it has as many rows as a vector has entries, whatever the table's size:
pivoted Cholesky gives a lower triangle (rows with the largest rest first, and
an end where nothing is left), and one-sided Jacobi rotations make its columns
orthogonal. Their squared norms are the eigenvalues, their directions the
components, and small eigenvalues keep their relative precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import named, packed, unpacked

SCALE, SHIFT = 64, 1_000_000
ADDED = ["deviation", "whitened"]
EXACT = 1 << 53  # whole numbers up to here are exact as doubles
ROUNDS = 60
# Below this share of the largest variance nothing but rounding is left.
REST = 1e-14


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with entry sums ``sums``; components as rows, by falling
    eigenvalue; ``trace`` of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if len(self.eigenvalues) else self.eigenvalues


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def usual_size(df: DataFrame, vector: str) -> int:
    """The most frequent number of entries (of equally frequent ones the largest)."""
    size = F.size(named(vector))
    row = (
        df.where(usable(named(vector))).groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("d")).first()
    )
    return row["d"] if row else 0


def fitting(df: DataFrame, vector: str, size: int) -> DataFrame:
    return df.where(usable(named(vector)) & (F.size(named(vector)) == size))


def whole(vectors: pa.ListArray, size: int) -> np.ndarray:
    """The entries as whole numbers, one row per vector."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size) + SHIFT


def products(z: np.ndarray) -> list[list[int]]:
    """z' z in exact whole numbers."""
    top = int(np.abs(z).max(initial=0))
    step = EXACT // max(top * top, 1)
    if step == 0:
        z = z.astype(object)
        return (z.T @ z).tolist()
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for i in range(0, len(z), step):
        part = z[i : i + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total.tolist()


def _summed(df: DataFrame, run, what: str) -> list:
    """Sums over all tasks of lists ``v`` (numbered ``i``), on the driver."""
    parts = df.mapInArrow(run, f"v array<{what}>")
    rows = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    found = {r["i"]: r["x"] for r in rows.collect()}
    return [found[i] for i in range(len(found))]


def _rows(vectors: DataFrame, size: int, work, what: pa.DataType, text: str) -> list:
    """Sum ``work(whole numbers)`` (a list) over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = np.array(work(whole(batch.column(0), size)), object)
                total = part if total is None else total + part
        if total is not None:
            flat = total.tolist()
            if pa.types.is_decimal(what):
                flat = [Decimal(x) for x in flat]
            yield pa.record_batch([pa.array([flat], pa.list_(what))], ["v"])

    return _summed(vectors, run, text)


def _exact_rows(vectors: DataFrame, size: int, work) -> list[int]:
    return [int(x) for x in _rows(vectors, size, work, pa.decimal128(38, 0), "decimal(38,0)")]


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivoted Cholesky: (L, order) with v[order][:, order] = L L', L lower with
    one column for each pivot above the rounding error."""
    v, d = v.copy(), len(v)
    order, low = np.arange(d), np.zeros((d, d))
    first = v.diagonal().max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(v.diagonal()[k:]))
        if v[p, p] <= REST * first or v[p, p] <= 0:
            return low[:, :k], order
        swap = [k, p]
        order[swap] = order[swap[::-1]]
        v[swap] = v[swap[::-1]]
        v[:, swap] = v[:, swap[::-1]]
        low[swap] = low[swap[::-1]]
        low[k, k] = np.sqrt(v[k, k])
        low[k + 1 :, k] = v[k + 1 :, k] / low[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def jacobi(low: np.ndarray) -> np.ndarray:
    """One-sided Jacobi: the matrix with its columns rotated until orthogonal."""
    a, r = low.copy(), low.shape[1]
    eps = np.finfo(float).eps
    for _ in range(ROUNDS):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                x, y = a[:, i], a[:, j]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= eps * np.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return a


def fit(df: DataFrame, vector: str = "embedding", size: int | None = None) -> Whitening:
    """Sums, components and eigenvalues of all usable vectors of ``size`` entries
    (by default the most frequent number)."""
    size = usual_size(df, vector) if size is None else size
    vectors = fitting(df, vector, size).select(named(vector).alias("v"))
    found = _exact_rows(vectors, size, lambda x: [len(x), *x.sum(axis=0).tolist()]) if size else []
    if not found:
        return Whitening(0, (0,) * size, np.zeros((0, size)), np.zeros(0), 0.0)
    n, sums = found[0], found[1:]
    means = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(means, np.int64)
    scatter = _exact_rows(vectors, size, lambda x: sum(products(x - centre), []))
    rest = [s - n * m for s, m in zip(sums, means)]
    cov = np.array(
        [
            [(n * scatter[i * size + j] - rest[i] * rest[j]) / (n * n) for j in range(size)]
            for i in range(size)
        ]
    )
    low, order = cholesky(cov)
    turned = jacobi(low)
    norms = np.sqrt((turned * turned).sum(axis=0))
    by = np.argsort(-norms, kind="stable")
    components = np.zeros((len(by), size))
    components[:, order] = (turned[:, by] / norms[by]).T
    return Whitening(n, tuple(sums), components, norms[by] ** 2, float(np.trace(cov)))


def _projection(model: Whitening, top: int):
    """Whole numbers to whitened values, as a function used inside tasks."""
    means = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    centre = np.array(means, np.int64)
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, means)])
    weights = (model.components[:top] / np.sqrt(model.eigenvalues[:top])[:, None]).T
    return lambda x: ((x - centre) - rest) @ weights


def identity_error(df: DataFrame, model: Whitening, top: int, vector: str = "embedding") -> float:
    """Largest entry of the whitened values' covariance less the identity, in a
    pass over all vectors. Whitened values are centred already; what is left of
    their mean is taken off."""
    top = min(top, len(model.eigenvalues))
    if top == 0:
        return 0.0
    size, project = len(model.sums), _projection(model, top)

    def work(x: np.ndarray) -> list[float]:
        y = project(x)
        return [*y.sum(axis=0).tolist(), *(y.T @ y).ravel().tolist()]

    vectors = fitting(df, vector, size).select(named(vector).alias("v"))
    found = np.array(_rows(vectors, size, work, pa.float64(), "double")) / model.n
    mean, second = found[:top], found[top:].reshape(top, top)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(top)).max())


def transform(df: DataFrame, model: Whitening, top: int = 32, vector: str = "embedding") -> DataFrame:
    """Every usable row with its deviation (sum over entries of (n x - S)^2, an
    exact long; the job fails where it does not fit one) and its ``whitened``
    values of up to ``top`` components.

    Rows whose vector is null, has a null or not finite entry or another number
    of entries than the model are left out. Input columns of the added names are
    replaced. Components without variance do not exist: with a single vector,
    or equal ones, ``whitened`` is empty. Repeated rows, null keys and further
    columns stay as they are; an empty table gives an empty result. No shuffle.
    """
    top = min(top, len(model.eigenvalues))
    size, n = len(model.sums), model.n
    project = _projection(model, top) if n else None
    sums = model.sums

    def run(vectors: pa.Array) -> pa.Array:
        x = whole(vectors, size)
        far = max(abs(n * int(x[:, k].max()) - s) + abs(n * int(x[:, k].min()) - s) for k, s in enumerate(sums)) if len(x) and size else 0
        kind = np.int64 if size * far * far < 1 << 63 else object
        off = x.astype(kind) * n - np.array(sums, kind)
        deviation = (off * off).sum(axis=1)
        values = project(x) if top else np.zeros((len(x), 0))
        ends = np.arange(len(x) + 1, dtype=np.int32) * top
        return pa.StructArray.from_arrays(
            [
                pa.array(deviation.tolist(), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())),
            ],
            ADDED,
        )

    if n == 0:
        rows = df.limit(0).select(packed(df), F.lit(None).cast("struct<deviation:long,whitened:array<double>>").alias("_w"))
    else:
        worked = F.arrow_udf(run, "struct<deviation:long,whitened:array<double>>")
        rows = fitting(df, vector, size).select(packed(df), worked(named(vector)).alias("_w"))
    return rows.select(*unpacked(df.columns, ADDED), F.col("_w.deviation"), F.col("_w.whitened"))
