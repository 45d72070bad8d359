"""Checks of profiles and series: peaks, stability over repeats, noise.

Thresholds have no defaults but the documented tolerance of peak positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.skew import attach
from .integrate import ID

# Largest relative shift of a calibrant's peak: the documented 1 %.
TOLERANCE = 0.01
PEAK = "struct<pos:int,place:double,height:double,prominence:double>"


def prominences(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of the local maxima of a curve.

    A merge tree: samples enter by falling height, each new one begins a hill or
    joins the hills beside it; of two hills that meet, the lower one (of equal
    ones the later) ends with the height it has above the meeting place. The
    highest hill ends at the lowest sample. A plateau counts at its first sample;
    a summit at an end of the curve is no peak, but what is beside it ends there.
    """
    n = len(y)
    order = np.lexsort((np.arange(n), -y))
    hill = [-1] * n  # for the two ends of each hill its summit
    other = [0] * n  # for an end of a hill its other end
    ended: dict[int, float] = {}
    for i in order.tolist():
        left = hill[i - 1] if i and hill[i - 1] >= 0 else -1
        right = hill[i + 1] if i + 1 < n and hill[i + 1] >= 0 else -1
        summit, lo, hi = i, i, i
        if left >= 0:
            summit, lo = left, other[i - 1]
        if right >= 0:
            hi = other[i + 1]
            if left < 0:
                summit = right
            else:
                summit, low = (left, right) if (-y[left], left) < (-y[right], right) else (right, left)
                if y[low] > y[i]:
                    ended[low] = float(y[low] - y[i])
        hill[i] = hill[lo] = hill[hi] = summit
        other[lo], other[hi] = hi, lo
    if n:
        top = int(order[0])
        ended[top] = float(y[top] - y.min())
    # where the plateau of each summit ends
    step = np.flatnonzero(np.diff(y) != 0)
    after = lambda k: int(step[np.searchsorted(step, k)]) if len(step) and k <= step[-1] else n - 1
    at = np.array(sorted(k for k, v in ended.items() if v > 0 and 0 < k and after(k) < n - 1), np.int64)
    return at, np.array([ended[k] for k in at.tolist()])


def vertex(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the maxima between samples: the vertex of the parabola through
    each with its two neighbours; at an end and on a plateau the sample itself."""
    inner = (at > 0) & (at < len(y) - 1)
    a, b, c = y[np.maximum(at - 1, 0)], y[at], y[np.minimum(at + 1, len(y) - 1)]
    bend = a - 2 * b + c
    ok = inner & (bend < 0) & (b >= a) & (b > c)
    return at + np.where(ok, (a - c) / np.where(ok, 2 * bend, 1.0), 0.0)


def peaks(profiles: DataFrame, min_prominence: float, curve: str = "radial_profile_data") -> DataFrame:
    """Profiles with ``peaks``: pos, sub-sample ``place``, height and prominence
    of the maxima whose prominence is at least ``min_prominence`` times the span
    of the curve, by position. A curve with a null or not finite value has null
    peaks, a flat or empty one none. Nothing shuffles."""

    def found(curves: pa.Array) -> pa.Array:
        kind = pa.struct([("pos", pa.int32()), ("place", pa.float64()), ("height", pa.float64()), ("prominence", pa.float64())])
        out = []
        for cell in curves.to_pylist():
            y = None if cell is None or None in cell else np.array(cell, dtype=float)
            if y is None or not np.isfinite(y).all():
                out.append(None)
                continue
            at, rise = prominences(y)
            ok = rise >= min_prominence * (y.max(initial=-np.inf) - y.min(initial=np.inf)) if len(y) else rise > 0
            at, rise = at[ok], rise[ok]
            rows = zip(at.tolist(), vertex(y, at).tolist(), y[at].tolist(), rise.tolist())
            out.append([dict(zip(kind.names, row)) for row in rows])
        return pa.array(out, pa.list_(kind))

    return profiles.withColumn("peaks", F.arrow_udf(found, f"array<{PEAK}>")(F.col(curve)))


def peak_position(place: Column, q: Column) -> Column:
    """q at a place between samples, by linear interpolation."""
    low = F.floor(place).cast("int")
    at = F.get(q, low)
    return at + (place - low) * F.coalesce(F.get(q, low + 1) - at, F.lit(0.0))


def peak_consistency(
    with_peaks: DataFrame,
    calibrant: str,
    window: float,
    tolerance: float = TOLERANCE,
    q: str = "q_range",
) -> DataFrame:
    """Whether the peaks of repeated calibrations stay where they were.

    The reference of a calibrant is its measurement with the smallest id that
    has peaks. Each of its peaks is sought in the other measurements of the
    calibrant: the nearest peak no further off than ``window`` (relative to q);
    the first of two equally near. One row per measurement and reference peak:
    ``q_reference``, ``q_found`` (null if none is near), relative ``shift`` and
    ``consistent`` (found, and the shift within the tolerance). Measurements
    without a calibrant or with null peaks are left out. The references, one
    small array per calibrant, are repeated for a few salts, so a calibrant with
    a third of all rows is spread.
    """
    rows = with_peaks.where(F.col("peaks").isNotNull() & F.col(calibrant).isNotNull()).select(
        ID, calibrant, F.transform("peaks", lambda p: peak_position(p["place"], F.col(q))).alias("_at")
    )
    reference = (
        rows.where(F.size("_at") > 0)
        .groupBy(calibrant)
        .agg(F.min_by("_at", ID).alias("_ref"), F.min(ID).alias("reference_id"))
    )
    joined = attach(rows, reference, [calibrant], [ID])

    def nearest(r: Column) -> Column:
        away = F.transform(F.col("_at"), lambda x: F.struct(F.abs(x - r).alias("d"), x.alias("x")))
        near = F.array_min(F.filter(away, lambda s: s["d"] <= F.abs(r) * window))
        return F.struct(r.alias("r"), near["x"].alias("x"))

    found = joined.select(ID, calibrant, "reference_id", F.posexplode(F.transform("_ref", nearest)).alias("peak", "_p"))
    shift = (F.col("_p.x") - F.col("_p.r")) / F.col("_p.r")
    return found.select(
        ID,
        calibrant,
        "reference_id",
        "peak",
        F.col("_p.r").alias("q_reference"),
        F.col("_p.x").alias("q_found"),
        shift.alias("shift"),
        F.coalesce(F.abs(shift) <= tolerance, F.lit(False)).alias("consistent"),
    )


def _lowest_sum(rows: DataFrame, keys: list[str], block: str, order: list[Column], x: str) -> DataFrame:
    """Adds ``_s``: the running sum of ``x`` less the lowest running sum so far
    (0 before the first): the cumulative sum that restarts at zero.

    Running sums and their minima combine block by block: a block is known by
    its sum and its lowest running sum. So each block is scanned alone, then the
    list of blocks, and no window holds a whole series."""
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("_p", F.sum(x).over(inside)).withColumn("_low", F.min("_p").over(inside))
    ends = scanned.groupBy(*keys, block).agg(F.sum(x).alias("_t"), F.min("_p").alias("_m"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    ends = ends.select(
        *keys, block, "_before", F.coalesce(F.min(F.col("_before") + F.col("_m")).over(before), F.lit(0.0)).alias("_floor")
    )
    at = F.col("_before") + F.col("_p")
    floor = F.least(F.lit(0.0), "_floor", F.col("_before") + F.col("_low"))
    return scanned.join(ends, [*keys, block]).withColumn("_s", at - floor).drop("_p", "_low", "_before", "_floor")


def intensity_stability(
    series: DataFrame,
    keys: list[str],
    slack: float,
    limit: float,
    intensity: str = "intensity",
    order: str = ID,
    block: int = 4096,
) -> DataFrame:
    """Whether the intensity of repeated measurements drifts: a two-sided CUSUM.

    With z the intensity less the mean of its series, in its standard
    deviations, the sums high = max(0, high + z - ``slack``) and low = max(0, low
    - z - ``slack``) run along ``order`` (a whole number, unique in its series).
    ``stable`` says that neither is above ``limit``. A series without variance
    has z = 0; null or NaN intensities are left out. A series is scanned in
    blocks of ``order`` values (``block`` of them each), so one long series is
    spread over many tasks.
    """
    value = F.col(intensity).cast("double")
    rows = series.where(value.isNotNull() & ~F.isnan(value)).withColumn("_v", value)
    stats = rows.groupBy(*keys).agg(F.avg("_v").alias("_mean"), F.stddev_pop("_v").alias("_std"))
    z = F.when(F.col("_std") > 0, (F.col("_v") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    rows = attach(rows, stats, keys, [order]).withColumn("z", z)
    rows = rows.withColumn("_block", F.floor(F.col(order) / block)).drop("_mean", "_std", "_v")
    place = [F.col(order)]
    rows = rows.withColumn("_up", F.col("z") - slack).withColumn("_down", -F.col("z") - slack)
    high = _lowest_sum(rows, keys, "_block", place, "_up").withColumnRenamed("_s", "high")
    both = _lowest_sum(high, keys, "_block", place, "_down").withColumnRenamed("_s", "low")
    stable = (F.col("high") <= limit) & (F.col("low") <= limit)
    return both.withColumn("stable", stable).drop("_block", "_up", "_down")


def _median(values: Column) -> Column:
    """Median of an array; null for an empty one."""
    ordered = F.array_sort(values)
    return F.transform(
        F.array(ordered), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    )[0]


def signal_quality(profiles: DataFrame, curve: str = "radial_profile_data") -> DataFrame:
    """Noise, signal and structure of every profile.

    * ``noise``: the median size of the second differences, scaled to a standard
      deviation (they cancel any straight trend; sharp peaks are few).
    * ``level``: the median; ``signal``: the largest value above it; ``snr`` =
      signal / noise.
    * ``runs_z``: the Wald-Wolfowitz statistic of the signs about the median. Pure
      noise changes sides at random (near 0); a diffraction feature or a trend
      stays on one side (strongly negative).

    Native array functions, no shuffle. A profile of fewer than three points or
    with a null or not finite value has nulls; so has ``snr`` without noise, and
    ``runs_z`` with all values on one side.
    """
    fine = F.coalesce(
        (F.size(curve) >= 3) & F.forall(curve, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False)
    )
    y = F.when(fine, F.col(curve))
    rows = profiles.withColumn("_y", y)
    bends = F.transform(
        F.sequence(F.lit(1), F.size("_y") - 2),
        lambda i: F.abs(F.get("_y", i - 1) - 2 * F.get("_y", i) + F.get("_y", i + 1)),
    )
    # a second difference of independent values has six times their variance
    scale = 0.6744897501960817 * 6**0.5
    rows = rows.withColumns({"level": _median(F.col("_y")), "noise": F.when(F.col("_y").isNotNull(), _median(bends) / scale)})
    rows = rows.withColumn("signal", F.array_max("_y") - F.col("level"))
    sides = F.filter(
        F.transform(F.col("_y"), lambda v: F.signum(v - F.col("level")).cast("int")), lambda s: s != 0
    )
    rows = rows.withColumn("_s", sides)
    runs = 1 + F.size(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("_s") - 1, F.lit(1))), lambda i: F.get("_s", i) != F.get("_s", i - 1))
    )
    up = F.size(F.filter("_s", lambda s: s > 0)).cast("double")
    down = F.size(F.filter("_s", lambda s: s < 0)).cast("double")
    rows = rows.withColumns({"_runs": runs, "_up": up, "_down": down})
    n, product = F.col("_up") + F.col("_down"), 2 * F.col("_up") * F.col("_down")
    mean = product / n + 1
    spread = F.sqrt(product * (product - n) / (n * n * (n - 1)))
    told = (F.col("_up") > 0) & (F.col("_down") > 0) & (product > n)
    return rows.withColumns(
        {
            "snr": F.when(F.col("noise") > 0, F.col("signal") / F.col("noise")),
            "runs_z": F.when(told, (F.col("_runs") - mean) / spread),
        }
    ).drop("_y", "_s", "_runs", "_up", "_down")


def quality_verdict(quality: DataFrame, kind: Column, min_snr: float, max_level: float, max_structure: float) -> DataFrame:
    """Adds ``passed`` by the kind of measurement: ``tissue`` needs a signal to
    noise ratio of ``min_snr``; ``background`` and ``empty`` ones no structure
    (``runs_z`` of -``max_structure`` or more, or none); ``dark`` ones no structure
    and a level of at most ``max_level``. Other kinds, and profiles without a
    finite curve, have null."""
    flat = F.coalesce(F.col("runs_z") >= -float(max_structure), F.lit(True))
    verdict = (
        F.when(F.col("level").isNull(), F.lit(None))
        .when(kind == "tissue", F.coalesce(F.col("snr") >= float(min_snr), F.col("signal") > 0))
        .when(kind.isin("background", "empty"), flat)
        .when(kind == "dark", flat & (F.abs("level") <= float(max_level)))
    )
    return quality.withColumn("passed", verdict)
