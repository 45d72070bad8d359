"""Checks of the diffraction pattern: symmetry of its rings, shape of its center."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.linear import solved
from .image import bright_runs, region_runs
from .integrate import AUTO, ID, Range, with_q_bin


def ring_harmonics(
    geo: DataFrame,
    npt: int,
    order: int = 2,
    q_range: Range = AUTO,
    weight: Column | None = None,
    least: float = 1e-3,
) -> DataFrame:
    """Circular harmonics of every q ring, by weighted least squares.

    Along a ring the intensity is fitted as mean + sum over k of (a_k cos k chi +
    b_k sin k chi). Pixels cover a ring unevenly (masks, edges, the square grid),
    so the functions are not orthogonal: their summed products enter, all from
    the sums of the cosines and sines of up to twice the order, so one shuffle
    after partial aggregation moves 6 ``order`` + 3 sums a ring. Adds ``mean``, and for each order
    ``index_k`` = amplitude / mean and ``phase_k``. A radially symmetric ring has
    indices near 0; a shifted beam shows in order 1, a stretched one in order 2.
    A ring whose coverage cannot tell the functions apart (less than the share
    ``least`` of one of them is its own) and one whose mean is not positive have
    nulls.
    """
    size = 2 * order + 1
    w = F.lit(1.0) if weight is None else weight.cast("double")
    chi = F.radians("chi")
    rows = with_q_bin(geo, npt, q_range).select(
        ID,
        "pos",
        w.alias("_w"),
        (w * F.col("value")).alias("_y"),
        *[F.cos(m * chi).alias(f"_c{m}") for m in range(1, 2 * order + 1)],
        *[F.sin(m * chi).alias(f"_s{m}") for m in range(1, 2 * order + 1)],
    )
    sums = {"C0": F.sum("_w"), "YC0": F.sum("_y"), "n_pixels": F.count(F.lit(1))}
    for m in range(1, 2 * order + 1):
        sums[f"C{m}"] = F.sum(F.col("_w") * F.col(f"_c{m}"))
        sums[f"S{m}"] = F.sum(F.col("_w") * F.col(f"_s{m}"))
    for m in range(1, order + 1):
        sums[f"YC{m}"] = F.sum(F.col("_y") * F.col(f"_c{m}"))
        sums[f"YS{m}"] = F.sum(F.col("_y") * F.col(f"_s{m}"))
    rings = rows.groupBy(ID, "pos").agg(*[c.alias(n) for n, c in sums.items()])

    def cosines(m: int) -> Column:
        return F.col(f"C{abs(m)}")

    def sines(m: int) -> Column:
        return F.lit(0.0) if m == 0 else F.col(f"S{abs(m)}") * (1 if m > 0 else -1)

    def product(i: int, j: int) -> Column:
        # functions in the order 1, cos 1, sin 1, cos 2, sin 2, ...
        a, b = (i + 1) // 2, (j + 1) // 2
        if i and i % 2 == 0 and j and j % 2 == 0:
            return (cosines(a - b) - cosines(a + b)) / 2
        if i and i % 2 == 0:
            return (sines(a + b) + sines(a - b)) / 2
        if j and j % 2 == 0:
            return (sines(a + b) + sines(b - a)) / 2
        return (cosines(a - b) + cosines(a + b)) / 2

    def right(i: int) -> Column:
        k = (i + 1) // 2
        return F.col(f"YS{k}" if i and i % 2 == 0 else f"YC{k}")

    fitted = solved(rings, size, product, right, least)
    mean = F.when(F.col("a0") > 0, F.col("a0"))
    out = [ID, "pos", "n_pixels", F.col("a0").alias("mean")]
    for k in range(1, order + 1):
        a, b = F.col(f"a{2 * k - 1}"), F.col(f"a{2 * k}")
        out.append((F.hypot(a, b) / mean).alias(f"index_{k}"))
        out.append(F.atan2(b, a).alias(f"phase_{k}"))
    return fitted.select(*out)


def asymmetry(harmonics: DataFrame, order: int = 2, min_pixels: int = 1) -> DataFrame:
    """Per image the mean index of each order over its rings, weighted by their
    pixels. Rings of fewer than ``min_pixels`` and rings without an index are left
    out; an image that has no other gets nulls."""
    used = F.when((F.col("n_pixels") >= min_pixels) & F.col("index_1").isNotNull(), F.col("n_pixels"))
    return harmonics.groupBy(ID).agg(
        F.count(used).alias("n_rings"),
        *[
            F.try_divide(F.sum(used * F.col(f"index_{k}")), F.sum(used)).alias(f"index_{k}")
            for k in range(1, order + 1)
        ],
    )


def center_shape(pixels: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Shape of the largest bright region of each image, the beam's center.

    The second moments of a region are sums over its runs of pixels, so they
    merge like counts; a pixel is a unit square, which adds 1/12 to both
    variances. Adds area, center_row, center_col, ``major`` and ``minor`` (half
    axes of the ellipse of equal moments), ``roundness`` = minor / major,
    ``angle`` of the major axis (degrees from the column axis, -90 to 90; 0 for
    a round one) and ``fill`` = area / area of that ellipse. A disc has roundness
    and fill 1; a ragged or hollow region fills less. An image without a bright
    region has nulls.
    """
    runs = region_runs(bright_runs(pixels, threshold))
    n = (F.col("last") - F.col("first") + 1).cast("double")
    r, mid = F.col("row_idx").cast("double"), (F.col("first") + F.col("last")) / 2.0
    regions = runs.groupBy(ID, "label").agg(
        F.sum(n).alias("n"),
        F.sum(n * r).alias("r"),
        F.sum(n * mid).alias("c"),
        F.sum(n * r * r).alias("rr"),
        F.sum(n * mid * r).alias("rc"),
        # squares of a run: its middle's, and its own variance (n^2 - 1) / 12
        F.sum(n * mid * mid + n * (n * n - 1) / 12.0).alias("cc"),
    )
    top = regions.groupBy(ID).agg(
        F.max_by(F.struct("n", "r", "c", "rr", "rc", "cc"), F.struct("n", -F.col("label"))).alias("_t")
    )
    t = {k: F.col(f"_t.{k}") for k in ("n", "r", "c", "rr", "rc", "cc")}
    row, col = t["r"] / t["n"], t["c"] / t["n"]
    moments = top.select(
        ID,
        t["n"].alias("area"),
        row.alias("center_row"),
        col.alias("center_col"),
        (t["rr"] / t["n"] - row * row + 1 / 12).alias("_rr"),
        (t["cc"] / t["n"] - col * col + 1 / 12).alias("_cc"),
        (t["rc"] / t["n"] - row * col).alias("_rc"),
    )
    half = (F.col("_rr") + F.col("_cc")) / 2
    reach = F.hypot((F.col("_cc") - F.col("_rr")) / 2, F.col("_rc"))
    shaped = moments.withColumns({"_half": half, "_reach": F.when(reach > 1e-9, reach).otherwise(0.0)})
    major, minor = F.sqrt(F.col("_half") + F.col("_reach")), F.sqrt(F.col("_half") - F.col("_reach"))
    found = shaped.select(
        ID,
        F.col("area").cast("long").alias("area"),
        "center_row",
        "center_col",
        (2 * major).alias("major"),
        (2 * minor).alias("minor"),
        (minor / major).alias("roundness"),
        F.when(F.col("_reach") == 0, 0.0)
        .otherwise(F.degrees(F.atan2(2 * F.col("_rc"), F.col("_cc") - F.col("_rr"))) / 2)
        .alias("angle"),
        (F.col("area") / (4 * F.pi() * major * minor)).alias("fill"),
    )
    return pixels.select(ID).distinct().join(found, ID, "left")
