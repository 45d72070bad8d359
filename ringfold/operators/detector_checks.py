"""Checks of the detector: pixels that stay broken, and traces of cosmic rays.

Thresholds have no defaults: which ones fit depends on the instrument.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written
from ..functions.skew import attach
from .integrate import ID

POSITION = ["row_idx", "col_idx"]
# Buckets of a sketch grow by this factor: quantiles are right to half of it.
GROWTH = 1.02
# The bucket of values that are not above zero.
NOTHING = -(1 << 30)
# A normal distribution's deviation, by the median distance from its median.
ROBUST = 1.4826


def bucket(value: Column, growth: float = GROWTH) -> Column:
    """Number of the geometric bucket (growth^(b-1), growth^b] of a value."""
    place = F.ceil(F.ln(value) / F.lit(float(np.log(growth)))).cast("int")
    return F.when(value > 0, place).otherwise(NOTHING)


def bucket_value(number: Column, growth: float = GROWTH) -> Column:
    """The value of a bucket with equal relative distance to both its ends."""
    inside = F.pow(F.lit(growth), number.cast("double")) * (2.0 / (growth + 1.0))
    return F.when(number == NOTHING, F.lit(0.0)).otherwise(inside)


def pixel_sketch(pixels: DataFrame, period: Column, growth: float = GROWTH) -> DataFrame:
    """A quantile sketch of each detector position and period.

    Values are taken relative to the mean of their image, so exposures of
    different brightness compare. A sketch is the count of values per geometric
    bucket; sketches of further measurements are merged by adding counts
    (``merged``). Rows: position, period, bucket, n. Counts are combined before
    the shuffle; there are at most as many rows as positions, periods and
    occupied buckets, however many measurements.
    """
    means = pixels.groupBy(ID).agg(F.avg("value").alias("_mean"))
    rows = attach(pixels, means, [ID], POSITION).where("_mean > 0")
    return (
        rows.select(
            *POSITION, period.alias("period"), bucket(F.col("value") / F.col("_mean"), growth).alias("bucket")
        )
        .groupBy(*POSITION, "period", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of all that agree in ``keys``, as one each."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def with_absent(sketch: DataFrame, pixels: DataFrame, period: Column, n_rows: int, n_cols: int) -> DataFrame:
    """The sketch with a zero for every image that has no row for a position
    (detectors that write lit pixels only). Periods times positions rows."""
    images = (
        pixels.select(ID, period.alias("period")).distinct()
        .groupBy("period").agg(F.count(F.lit(1)).alias("_images"))
    )
    place = F.explode(F.sequence(F.lit(0), F.lit(n_rows * n_cols - 1)))
    grid = images.select("period", "_images", place.alias("_at")).select(
        "period",
        "_images",
        F.floor(F.col("_at") / n_cols).cast("int").alias("row_idx"),
        (F.col("_at") % n_cols).alias("col_idx"),
    )
    seen = sketch.groupBy(*POSITION, "period").agg(F.sum("n").alias("_seen"))
    left = F.col("_images") - F.coalesce("_seen", F.lit(0))
    zeros = grid.join(seen, [*POSITION, "period"], "left").select(
        *POSITION, "period", F.lit(NOTHING).alias("bucket"), left.alias("n")
    )
    return merged(sketch.unionByName(zeros.where("n > 0")), *POSITION, "period")


def quantile(sketch: DataFrame, keys: list[str], level: float, name: str, growth: float = GROWTH) -> DataFrame:
    """Per key the value at ``level`` of its sketch. A window holds the buckets
    of one sketch."""
    own = Window.partitionBy(*keys)
    upto = F.sum("n").over(own.orderBy("bucket"))
    need = F.greatest(F.ceil(F.sum("n").over(own) * F.lit(float(level))), F.lit(1))
    rows = sketch.select(*keys, "bucket", (upto >= need).alias("_reached"))
    return rows.where("_reached").groupBy(*keys).agg(bucket_value(F.min("bucket"), growth).alias(name))


def pixel_persistence(
    pixels: DataFrame,
    period: Column,
    n_rows: int,
    n_cols: int,
    dead: float,
    hot: float,
    level: float = 0.5,
    growth: float = GROWTH,
) -> DataFrame:
    """Per detector position in how many periods it was dead or hot.

    In a period a position is dead (hot) if its value at ``level`` is at most
    ``dead`` (at least ``hot``) times that of all positions together. What moves
    with the sample changes places between periods; a broken pixel does not.
    Adds ``n_periods``, ``n_dead``, ``n_hot`` and ``ratio`` (of the mean over the
    periods). Absent pixels are zeros. A period whose positions together have a
    zero at ``level`` tells nothing and is left out.
    """
    sketch = pixel_sketch(pixels, period, growth)
    sketch = written(with_absent(sketch, pixels, period, n_rows, n_cols), "pixel-sketch")
    own = quantile(sketch, [*POSITION, "period"], level, "_own", growth)
    every = quantile(merged(sketch, "period"), ["period"], level, "_every", growth)
    ratio = F.col("_own") / F.col("_every")
    return (
        own.join(every.where("_every > 0"), "period")
        .groupBy(*POSITION)
        .agg(
            F.count(F.lit(1)).alias("n_periods"),
            F.count_if(ratio <= float(dead)).alias("n_dead"),
            F.count_if(ratio >= float(hot)).alias("n_hot"),
            F.avg(ratio).alias("ratio"),
        )
    )


def broken_pixels(persistence: DataFrame, min_share: float, min_periods: int = 2) -> DataFrame:
    """Positions that were dead, or hot, in ``min_share`` of at least
    ``min_periods`` periods, with their ``kind``."""
    enough = F.col("n_periods") * float(min_share)
    kind = F.when(F.col("n_dead") >= enough, "dead").when(F.col("n_hot") >= enough, "hot")
    return (
        persistence.where(F.col("n_periods") >= min_periods)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
    )


def without_positions(pixels: DataFrame, broken: DataFrame) -> DataFrame:
    """Pixel rows but those of the listed detector positions."""
    return pixels.join(broken.select(*POSITION), POSITION, "left_anti")


AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _middle(stack: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Median over the first axis of values followed by NaN for absent ones."""
    stack = np.sort(stack, axis=0)
    low, high = np.maximum(count - 1, 0) // 2, count // 2
    take = lambda at: np.take_along_axis(stack, np.minimum(at, len(stack) - 1)[None], axis=0)[0]
    return (take(low) + take(high)) / 2


def neighbourhood(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the up to eight neighbours of every pixel, and their median
    distance from it."""
    rows, cols = image.shape
    halo = np.full((rows + 2, cols + 2), np.nan)
    halo[1:-1, 1:-1] = image
    stack = np.stack([halo[1 + r : 1 + r + rows, 1 + c : 1 + c + cols] for r, c in AROUND])
    count = np.isfinite(stack).sum(axis=0)
    stack[~np.isfinite(stack)] = np.nan
    middle = _middle(stack, count)
    return middle, _middle(np.abs(stack - middle), count)


def run_lengths(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each listed pixel the longest straight run of listed pixels through
    it: along its row, column or a diagonal."""
    best = np.ones(len(rows), np.int64)
    for line, at in ((rows, cols), (cols, rows), (rows - cols, rows), (rows + cols, rows)):
        order = np.lexsort((at, line))
        l, a = line[order], at[order]
        start = np.ones(len(l), bool)
        start[1:] = (l[1:] != l[:-1]) | (a[1:] != a[:-1] + 1)
        number = np.cumsum(start) - 1
        size = np.bincount(number)[number] if len(number) else number
        best[order] = np.maximum(best[order], size)
    return best


def _spikes(image: np.ndarray, factor: float, least: float, max_run: int):
    middle, distance = neighbourhood(image)
    with np.errstate(invalid="ignore"):
        high = image - middle > factor * np.maximum(ROBUST * distance, least)
    rows, cols = np.nonzero(high)
    runs = run_lengths(rows, cols)
    ok = runs <= max_run
    rows, cols = rows[ok], cols[ok]
    return rows, cols, image[rows, cols], middle[rows, cols], runs[ok]


def _image(cell) -> np.ndarray | None:
    """An image cell as a matrix; None if it is null, empty or ragged."""
    if not cell or any(line is None or len(line) != len(cell[0]) for line in cell) or not len(cell[0]):
        return None
    return np.array(cell, dtype=float)


def cosmic_rays(
    images: DataFrame, factor: float, least: float, max_run: int, image: str = "measurement_data"
) -> DataFrame:
    """Images with ``rays``: their pixels hit by cosmic rays.

    A pixel sticks out if it exceeds the median of its neighbours by more than
    ``factor`` times their robust deviation, which counts as ``least`` at least. Such
    pixels belong to a ray if no straight run of them is longer than ``max_run``:
    a ray hits one pixel or a short streak, rings and edges are longer. Each has
    row_idx, col_idx, value, ``background`` (the neighbours' median) and ``run``.
    The stencil stays inside the image cell: nothing shuffles. A null or ragged
    image has null rays. Null and infinite pixels are nobody's neighbours.
    """
    kind = pa.struct(
        [("row_idx", pa.int32()), ("col_idx", pa.int32()), ("value", pa.float64()), ("background", pa.float64()), ("run", pa.int64())]
    )

    def found(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells.to_pylist():
            matrix = _image(cell)
            if matrix is None:
                out.append(None)
                continue
            columns = _spikes(matrix, factor, least, max_run)
            out.append([dict(zip(kind.names, row)) for row in zip(*(c.tolist() for c in columns))])
        return pa.array(out, pa.list_(kind))

    text = "array<struct<row_idx:int,col_idx:int,value:double,background:double,run:long>>"
    return images.withColumn("rays", F.arrow_udf(found, text)(F.col(image)))


def without_rays(images: DataFrame, image: str = "measurement_data") -> DataFrame:
    """Images of ``cosmic_rays`` with the background in place of each ray pixel."""
    at = F.map_from_entries(
        F.transform("rays", lambda r: F.struct(r["row_idx"] * F.size(F.get(image, F.lit(0))) + r["col_idx"], r["background"]))
    )
    clean = F.transform(
        F.array(at),
        lambda m: F.transform(
            image,
            lambda line, r: F.transform(line, lambda v, c: F.coalesce(F.try_element_at(m, r * F.size(line) + c), v)),
        ),
    )[0]
    return images.withColumn(image, F.when(F.size("rays") > 0, clean).otherwise(F.col(image)))
