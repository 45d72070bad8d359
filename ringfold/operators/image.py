"""Geometry of whole images: cuts, resizing, common region, beam."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.skew import attach
from .calibration import poni_from_pixels, with_center
from .integrate import ID

Ring = tuple[float | None, float | None]


def ring_cut(rows: DataFrame, rings: list[Ring]) -> DataFrame:
    """Zero the pixels whose distance from the center, in whole pixel indices,
    lies in any ring. Bounds are inclusive, None is open."""
    if not rings:
        return rows
    r = F.sqrt(
        F.pow(F.col("col_idx") - F.col("poni2") / F.col("pixel2"), 2)
        + F.pow(F.col("row_idx") - F.col("poni1") / F.col("pixel1"), 2)
    )
    inside = F.lit(False)
    for low, high in rings:
        hit = F.lit(True)
        if low is not None:
            hit = hit & (r >= float(low))
        if high is not None:
            hit = hit & (r <= float(high))
        inside = inside | hit
    return rows.withColumn(
        "value", F.when(inside, F.lit(0.0)).otherwise(F.col("value"))
    )


def _cubic(t: Column) -> Column:
    """Cubic convolution kernel with a = -0.75."""
    a = -0.75
    t = F.abs(t)
    return (
        F.when(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1)
        .when(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a)
        .otherwise(0.0)
    )


def resize_weights(sizes: DataFrame, n: int, axis: str) -> DataFrame:
    """(target size, source index, target index, weight) along one axis of ``n``
    pixels, for each of the distinct sizes. Taps beyond the edge repeat the edge
    pixel, so their weights add up on it."""
    size = f"{axis}_size"
    grid = sizes.select(
        size, F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias(f"{axis}_out")
    )
    at = (F.col(f"{axis}_out") + 0.5) * (F.lit(float(n)) / F.col(size)) - 0.5
    taps = grid.withColumn("_at", at).withColumn(
        "_tap", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1, 2)]))
    )
    source = F.floor("_at") + F.col("_tap")
    return (
        taps.select(
            size,
            F.greatest(F.lit(0), F.least(F.lit(n - 1), source))
            .cast("int")
            .alias(f"{axis}_idx"),
            f"{axis}_out",
            _cubic(F.col("_at") - source).alias("_w"),
        )
        .groupBy(size, f"{axis}_idx", f"{axis}_out")
        .agg(F.sum("_w").alias(f"{axis}_w"))
    )


def image_resize(
    pixels: DataFrame,
    calibrations: DataFrame,
    ref_distance_mm: float,
    n_rows: int,
    n_cols: int,
) -> DataFrame:
    """Rescale images to a reference distance by cubic interpolation, values
    rounded into 0..65535. Separable: along rows, then along columns, each a
    join with a weight table and a sum. Weights depend on the target size alone,
    a whole number, so there is one table of them for each size that occurs,
    however many calibrations there are."""
    k = F.lit(ref_distance_mm * 0.001) / F.col("distance_m")
    sized = calibrations.select(
        "cal_id",
        F.floor(F.lit(n_rows) * k + 1e-9).cast("int").alias("row_size"),
        F.floor(F.lit(n_cols) * k + 1e-9).cast("int").alias("col_size"),
    )
    down, across = (
        resize_weights(sized.select(f"{axis}_size").where(f"{axis}_size > 0").distinct(), n, axis)
        for axis, n in (("row", n_rows), ("col", n_cols))
    )
    # a calibration given twice counts twice along either axis
    pairs = F.transform(
        "_sizes",
        lambda a: F.transform("_sizes", lambda b: F.struct(a["row_size"].alias("row_size"), b["col_size"].alias("col_size"))),
    )
    sizes = (
        sized.groupBy("cal_id")
        .agg(F.collect_list(F.struct("row_size", "col_size")).alias("_sizes"))
        .select("cal_id", F.inline(F.flatten(pairs)))
        .where("row_size > 0 and col_size > 0")
    )
    whole = F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.floor("value")))
    values = pixels.select(ID, "cal_id", "row_idx", "col_idx", whole.alias("v"))
    step = (
        attach(values, sizes, ["cal_id"], [ID, "row_idx", "col_idx"])
        .join(down, ["row_size", "row_idx"])
        .groupBy(ID, "cal_id", "col_size", "row_out", "col_idx")
        .agg(F.sum(F.col("v") * F.col("row_w")).alias("v"))
    )
    done = (
        step.join(across, ["col_size", "col_idx"])
        .groupBy(ID, "cal_id", "row_out", "col_out")
        .agg(F.sum(F.col("v") * F.col("col_w")).alias("v"))
    )
    # round-off is removed first, so an exact half rounds to even
    rounded = F.bround(F.round("v", 9), 0)
    return done.select(
        ID,
        "cal_id",
        F.col("row_out").alias("row_idx"),
        F.col("col_out").alias("col_idx"),
        F.greatest(F.lit(0.0), F.least(F.lit(65535.0), rounded)).alias("value"),
    )


def common_region(
    exposures: DataFrame, n_rows: int, n_cols: int, square: bool = False
) -> DataFrame:
    """One row: smallest distances from the center to the borders. The axis
    names follow the convention up/down = center_x, left/right = center_y."""
    centers = with_center(exposures)
    box = centers.agg(
        F.min("center_x").alias("max_up"),
        F.min(F.lit(n_rows) - F.col("center_x")).alias("max_down"),
        F.min("center_y").alias("max_left"),
        F.min(F.lit(n_cols) - F.col("center_y")).alias("max_right"),
    )
    if square:
        height = F.col("max_up") + F.col("max_down")
        width = F.col("max_left") + F.col("max_right")
        tall = height >= width
        box = box.select(
            *[
                F.when(tall, F.col(c) / height * width)
                .otherwise(F.col(c))
                .alias(c)
                for c in ("max_up", "max_down")
            ],
            *[
                F.when(~tall, F.col(c) / width * height)
                .otherwise(F.col(c))
                .alias(c)
                for c in ("max_left", "max_right")
            ],
        )
    return box.select(*[F.floor(c).cast("double").alias(c) for c in box.columns])


def common_crop(rows: DataFrame, region: DataFrame) -> DataFrame:
    """Crop pixel rows that carry their calibration to the common region and
    move the calibration along. The region enters as a scalar subquery."""
    box = region.select(F.struct(*region.columns)).scalar()
    framed = with_center(rows.withColumn("_box", box))

    def edge(center: str, side: str, sign: int) -> Column:
        return F.expr(
            f"cast({center} {'+' if sign > 0 else '-'} _box.{side} as int)"
        )

    framed = framed.withColumns(
        {
            "_x0": edge("center_x", "max_up", -1),
            "_x1": edge("center_x", "max_down", 1),
            "_y0": edge("center_y", "max_left", -1),
            "_y1": edge("center_y", "max_right", 1),
        }
    )
    inside = framed.filter(
        (F.col("row_idx") >= F.col("_y0"))
        & (F.col("row_idx") < F.col("_y1"))
        & (F.col("col_idx") >= F.col("_x0"))
        & (F.col("col_idx") < F.col("_x1"))
    ).withColumns(
        {
            "row_idx": F.col("row_idx") - F.col("_y0"),
            "col_idx": F.col("col_idx") - F.col("_x0"),
        }
    )
    moved = poni_from_pixels(
        inside, F.col("_box.max_up"), F.col("_box.max_left")
    )
    return with_center(moved).drop("_box", "_x0", "_x1", "_y0", "_y1")


def bright_pixels(pixels: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Pixels above ``threshold`` times the mean of their image."""
    means = pixels.groupBy(ID).agg(F.avg("value").alias("_mean"))
    return (
        attach(pixels, means, [ID], ["row_idx", "col_idx"])
        .filter(F.col("value") > threshold * F.col("_mean"))
        .select(ID, "row_idx", "col_idx")
    )


# Row and column indices are 32-bit numbers: row * LINE + col tells all pixels
# apart and keeps the reading order.
LINE = 1 << 32


def pixel_runs(lit_pixels: DataFrame) -> DataFrame:
    """Runs of neighbouring pixels: measurement, row_idx, first and last column.

    A window holds one line of one detector."""
    line = Window.partitionBy(ID, "row_idx").orderBy("col_idx")
    nodes = lit_pixels.select(ID, "row_idx", "col_idx").distinct()
    island = F.col("col_idx") - F.row_number().over(line)
    return (
        nodes.withColumn("_island", island)
        .groupBy(ID, "row_idx", "_island")
        .agg(F.min("col_idx").alias("first"), F.max("col_idx").alias("last"))
        .drop("_island")
    )


def joined_runs(rows: list[int], first: list[int], last: list[int]) -> list[int]:
    """For runs in reading order the place of the first run of their region.
    Runs of neighbouring rows touch if their columns do, diagonals included."""
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above = 0
    for i in range(len(rows)):
        # runs of the row above that end before this one starts are over
        while above < i and (
            rows[above] < rows[i] - 1 or (rows[above] == rows[i] - 1 and last[above] < first[i] - 1)
        ):
            above += 1
        k = above
        while k < i and rows[k] == rows[i] - 1 and first[k] <= last[i] + 1:
            a, b = top(k), top(i)
            root[max(a, b)] = min(a, b)
            k += 1
    return [top(i) for i in range(len(rows))]


def region_runs(runs: DataFrame) -> DataFrame:
    """Runs with the ``label`` of their 8-connected region: its first pixel in
    reading order.

    The runs of an image are put together in one row (at most half as many as
    it has pixels, whatever the table's size) and joined there, so labels need
    one shuffle and no rounds.
    """

    def labelled(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        rows, first, last = (flat.field(i).to_pylist() for i in range(3))
        ends = lists.offsets.to_pylist()
        base, out = ends[0], []
        for i, j in zip(ends[:-1], ends[1:]):
            i, j = i - base, j - base
            out.append([rows[i + k] * LINE + first[i + k] for k in joined_runs(rows[i:j], first[i:j], last[i:j])])
        return pa.array(out, pa.list_(pa.int64()))

    images = runs.groupBy(ID).agg(
        F.sort_array(F.collect_list(F.struct("row_idx", "first", "last"))).alias("_runs")
    )
    label = F.arrow_udf(labelled, "array<bigint>")
    return images.select(
        ID, F.explode(F.arrays_zip(F.col("_runs").alias("run"), label("_runs").alias("label"))).alias("_r")
    ).select(ID, "_r.run.row_idx", "_r.run.first", "_r.run.last", "_r.label")


def label_regions(lit_pixels: DataFrame) -> DataFrame:
    """Pixels (``node`` = row * LINE + column) with the ``label`` of their region."""
    runs = region_runs(pixel_runs(lit_pixels))
    base = F.col("row_idx").cast("long") * LINE
    nodes = F.sequence(base + F.col("first"), base + F.col("last"))
    return runs.select(ID, F.explode(nodes).alias("node"), "label")


def bright_runs(pixels: DataFrame, threshold: float = 3.0) -> DataFrame:
    return pixel_runs(bright_pixels(pixels, threshold))


def beam_center(pixels: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Centroid of the largest bright region per image; the first in reading
    order wins a tie, an image without one gets nulls."""
    runs = region_runs(bright_runs(pixels, threshold))
    n = F.col("last") - F.col("first") + 1
    regions = runs.groupBy(ID, "label").agg(
        F.sum(n).cast("long").alias("area"),
        F.sum(n * F.col("row_idx")).alias("rows"),
        F.sum(n * (F.col("first") + F.col("last")) / 2.0).alias("cols"),
    )
    top = regions.groupBy(ID).agg(
        F.max_by(
            F.struct(
                (F.col("rows") / F.col("area")).alias("center_row"),
                (F.col("cols") / F.col("area")).alias("center_col"),
                "area",
            ),
            F.struct("area", -F.col("label")),
        ).alias("_top")
    )
    return (
        pixels.select(ID)
        .distinct()
        .join(top, ID, "left")
        .select(ID, "_top.center_row", "_top.center_col", "_top.area")
    )


def beam_box(
    pixels: DataFrame,
    thresh: float,
    padding: int = 0,
    n_rows: int = 256,
    n_cols: int = 256,
) -> DataFrame:
    """Pixel rows with ``beam``: the value inside the padded bounding box of the
    pixels above the threshold, else 0. An image without any has no beam."""
    box = (
        pixels.filter(F.col("value") > thresh)
        .groupBy(ID)
        .agg(
            F.greatest(F.lit(0), F.min("row_idx") - padding).alias("_r0"),
            F.least(F.lit(n_rows - 1), F.max("row_idx") + padding).alias("_r1"),
            F.greatest(F.lit(0), F.min("col_idx") - padding).alias("_c0"),
            F.least(F.lit(n_cols - 1), F.max("col_idx") + padding).alias("_c1"),
        )
    )
    inside = F.col("row_idx").between(F.col("_r0"), F.col("_r1")) & F.col(
        "col_idx"
    ).between(F.col("_c0"), F.col("_c1"))
    return (
        attach(pixels, box, [ID], ["row_idx", "col_idx"], how="left")
        .withColumn("beam", F.when(inside, F.col("value")).otherwise(0.0))
        .drop("_r0", "_r1", "_c0", "_c1")
    )


def mask_product(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Image times mask; a position the mask does not list counts as 0.

    All images meet a mask's position, so they are spread by measurement."""
    listed = mask.select("row_idx", "col_idx", "m")
    return (
        attach(pixels, listed, ["row_idx", "col_idx"], [ID])
        .withColumn("value", F.col("value") * F.col("m"))
        .drop("m")
    )
