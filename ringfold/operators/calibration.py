"""Calibration text and geometry, computed once per distinct calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import attach

# The words that open a line of a calibration text, in order.
LINE_WORDS = [
    "# Nota:",
    "# Calibration",
    "poni_version:",
    "Detector:",
    "Detector_config:",
    "Distance:",
    "Poni1:",
    "Poni2:",
    "Rot1:",
    "Rot2:",
    "Rot3:",
    "Wavelength:",
    "# Calibrant:",
    "# Image:",
]


def _entries(text: Column) -> Column:
    """The text's lines as a map from the word before the colon to the rest."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("key"),
            F.trim(F.substr(x, F.locate(":", x) + 1)).alias("value"),
        ),
    )
    # of lines that repeat a word, the first counts
    keys = F.transform(pairs, lambda p: p["key"])
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(firsts)


def parse_text(df: DataFrame, text: str = "ponifile") -> DataFrame:
    """Add the calibration columns read from the text, line by line."""
    read = df.withColumn("_read", _entries(F.col(text)))

    def number(word: str) -> Column:
        return F.expr(f"try_cast(_read['{word}'] as double)")

    def config(name: str) -> Column:
        return F.get_json_object(F.col("_read")["Detector_config"], f"$.{name}").cast("double")

    return read.withColumns(
        {
            "distance_m": number("Distance"),
            "poni1": number("Poni1"),
            "poni2": number("Poni2"),
            "pixel1": config("pixel1"),
            "pixel2": config("pixel2"),
            "wavelength_nm": number("Wavelength") * 1e9,
            **{t: F.coalesce(number(t.capitalize()), F.lit(0.0)) for t in TILTS},
        }
    ).drop("_read")


def from_columns(df: DataFrame) -> DataFrame:
    """Calibration columns from pixel_size (um), center (row, col),
    calculated_distance (m) and wavelength (nm)."""
    size = F.col("pixel_size") * 1e-6
    return df.withColumns(
        {
            "distance_m": F.col("calculated_distance"),
            "pixel1": size,
            "pixel2": size,
            "poni1": F.col("center.row") * size,
            "poni2": F.col("center.col") * size,
            "wavelength_nm": F.col("wavelength"),
        }
    )


def with_center(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "center_x": F.col("poni2") / F.col("pixel2"),
            "center_y": F.col("poni1") / F.col("pixel1"),
        }
    )


def poni_from_pixels(df: DataFrame, center_x: Column, center_y: Column) -> DataFrame:
    return df.withColumns(
        {
            "poni1": center_y * F.col("pixel1"),
            "poni2": center_x * F.col("pixel2"),
        }
    )


def scale_poni(df: DataFrame, k: Column) -> DataFrame:
    return df.withColumns(
        {"poni1": F.col("poni1") * k, "poni2": F.col("poni2") * k}
    )


def number_text(value: Column, digits: int = 12) -> Column:
    """Plain decimal text without trailing zeros."""
    text = F.format_string(f"%.{digits}f", value)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def substitute(text: Column, word: str, value_text: Column) -> Column:
    """Replace the rest of the line after ``word:``. As in a plain text search,
    the first occurrence counts and the value follows the colon directly."""
    start = F.locate(word, text) + len(word)
    head = F.substring(text, F.lit(1), start)
    tail = F.substring(text, start + 1, F.length(text))
    line_end = F.locate("\n", tail)
    rest = F.when(line_end > 0, F.substring(tail, line_end, F.length(tail)))
    return F.concat(head, value_text, F.coalesce(rest, F.lit("")))


def substitute_poni(text: Column, poni1: Column, poni2: Column) -> Column:
    once = substitute(text, "Poni1", number_text(poni1))
    return substitute(once, "Poni2", number_text(poni2))


def format_text(text: Column) -> Column:
    """Put each known word on a line of its own, unless the text has lines.

    The words are looked up in their order, each from where the last was found.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(1).alias("at")
    )

    def cut(acc: Column, word: Column) -> Column:
        at = acc.getField("at")
        tail = F.substring(text, at, F.length(text))
        offset = F.call_function("locate", word, tail)
        piece = F.trim(F.substring(tail, F.lit(1), offset - 1), F.lit(" \t\r"))
        return F.when(offset <= 1, acc).otherwise(
            F.struct(
                F.concat(acc.getField("parts"), F.array(piece)).alias("parts"),
                (at + offset - 1).alias("at"),
            )
        )

    def finish(acc: Column) -> Column:
        last = F.trim(
            F.substring(text, acc.getField("at"), F.length(text)), F.lit(" \t\r")
        )
        return F.array_join(F.concat(acc.getField("parts"), F.array(last)), "\n")

    words = F.array(*[F.lit(w) for w in LINE_WORDS])
    return F.when(text.contains("\n"), text).otherwise(
        F.aggregate(words, start, cut, finish)
    )


def thickness_distance(thickness: Column, reference_mm: float = 700.0) -> Column:
    """Distance corrected by half the sample thickness (mm in, m out)."""
    return F.round((F.lit(reference_mm) - thickness / 2) / 1000.0, 6)


TILTS = ("rot1", "rot2", "rot3")


def _tilt(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def turned(df: DataFrame, y: Column, x: Column) -> tuple[Column, Column, Column]:
    """A place on the detector, given from the foot of its normal (m), in the
    frame of the beam: two coordinates across it and one along.

    The detector is turned by ``rot1``, ``rot2`` and ``rot3`` (radians) about its
    second axis, its first axis and the beam. Without these columns, or where
    they are null, it is untilted.
    """
    if not any(name in df.columns for name in TILTS):
        return y, x, F.col("distance_m")
    r1, r2, r3 = (_tilt(df, name) for name in TILTS)
    # about the second axis, then the first: the three coordinates so far
    across, along = x * F.cos(r1) + F.col("distance_m") * F.sin(r1), F.col(
        "distance_m"
    ) * F.cos(r1) - x * F.sin(r1)
    up, ahead = y * F.cos(r2) - along * F.sin(r2), y * F.sin(r2) + along * F.cos(r2)
    return up * F.cos(r3) - across * F.sin(r3), up * F.sin(r3) + across * F.cos(r3), ahead


def with_geometry(df: DataFrame) -> DataFrame:
    """Scattering vector q (1/nm) and azimuth chi (degrees) of a pixel row that
    carries its calibration columns, tilts included if it has them."""
    y = (F.col("row_idx") + 0.5) * F.col("pixel1") - F.col("poni1")
    x = (F.col("col_idx") + 0.5) * F.col("pixel2") - F.col("poni2")
    up, across, ahead = turned(df, y, x)
    return df.withColumns(
        {
            "q": _q(up, across, ahead),
            "chi": F.degrees(F.atan2(up, across)),
        }
    )


def _q(up: Column, across: Column, ahead: Column) -> Column:
    r = F.sqrt(across * across + up * up)
    return F.lit(4 * math.pi) / F.col("wavelength_nm") * F.sin(F.atan2(r, ahead) / 2)


def full_q_range(df: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Smallest and largest q on the detector, per calibration.

    Lines of equal q enclose the place where the beam meets the detector, so a
    corner has the largest q, and the smallest is at the pixel nearest to that
    place or next to it; no pass over pixels is needed. A tilted detector that
    the beam misses has its smallest q somewhere on its edges, so all their pixels
    are tried as well.
    """
    tilted = any(name in df.columns for name in TILTS)
    r1, r2 = _tilt(df, "rot1"), _tilt(df, "rot2")
    foot_y, foot_x = F.col("poni1"), F.col("poni2")
    if tilted:
        foot_y = foot_y + F.col("distance_m") * F.tan(r2) / F.cos(r1)
        foot_x = foot_x - F.col("distance_m") * F.tan(r1)

    def places(n: int, pixel: str, poni: str, foot: Column) -> tuple[Column, ...]:
        """Coordinates to try on one axis: beside the beam, at the ends, and all;
        and whether the beam is beyond the ends."""
        size, origin = F.col(pixel), F.col(poni)
        at = F.floor(foot / size).cast("int")
        steps = F.array(*[at + k for k in ((-1, 0, 1) if tilted else (0,))])
        last = F.lit(n) - 1 if isinstance(n, int) else n - 1

        def place(i: Column) -> Column:
            return (F.greatest(F.lit(0), F.least(last, i)) + 0.5) * size - origin

        tries = (steps, F.array(F.lit(0), last), F.sequence(F.lit(0), last))
        return *[F.transform(i, place) for i in tries], (at < 0) | (at > last)

    def tried(ys: Column, xs: Column) -> Column:
        return F.flatten(
            F.transform(ys, lambda y: F.transform(xs, lambda x: _q(*turned(df, y, x))))
        )

    near_y, ends_y, all_y, off_y = places(n_rows, "pixel1", "poni1", foot_y)
    near_x, ends_x, all_x, off_x = places(n_cols, "pixel2", "poni2", foot_x)
    q_lo = F.array_min(tried(near_y, near_x))
    if tilted:
        # a detector that faces away meets the beam's other side, if any
        missed = off_y | off_x | (F.cos(r1) * F.cos(r2) <= 0)
        edges = F.concat(tried(ends_y, all_x), tried(all_y, ends_x))
        q_lo = F.when(missed, F.least(q_lo, F.array_min(edges))).otherwise(q_lo)
    return df.withColumns(
        {
            "q_lo": q_lo,
            "q_hi": F.array_max(tried(ends_y, ends_x)),
        }
    )


def attach_calibration(
    rows: DataFrame, calibrations: DataFrame, on: str = "cal_id"
) -> DataFrame:
    """Join the calibration columns to measurement or pixel rows.

    The dimension holds one row per calibration and is broadcast when its size
    allows it. Else the rows are spread by measurement and position, since most
    of them may share one calibration.
    """
    wanted = [
        c
        for c in calibrations.columns
        if c == on or c not in rows.columns
    ]
    spread = [c for c in ("measurement_id", "row_idx", "col_idx") if c in rows.columns]
    if not spread:
        return rows.join(calibrations.select(*wanted), on)
    return attach(rows, calibrations.select(*wanted), [on], spread)
