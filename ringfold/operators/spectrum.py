"""Two-dimensional spectra, Hankel transform and roughness.

A 2-D transform is separable: transform every line, shuffle once so that
columns come together, transform every column. Grouping is by line, so a task
never holds more than a batch of lines, whatever the number of pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import attach
from ..functions.special import hankel_kernel
from .image import beam_box
from .integrate import ID


def along_axis(
    df: DataFrame,
    keys: list[str],
    pos: str,
    n: int,
    transform: Callable[[np.ndarray], np.ndarray],
    out: str,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Apply a linear map to the n-vector of every key; absent entries are 0.

    ``df`` has columns ``re`` and ``im``; the result has them again at the new
    position ``out``. ``carry`` adds aggregates that are constant per key.
    """

    @F.pandas_udf("struct<re: array<double>, im: array<double>>")
    def mapped(at: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        lines = np.zeros((len(at), n), dtype=complex)
        if len(at):
            owner = np.repeat(np.arange(len(at)), at.map(len).to_numpy())
            cells = np.concatenate(re.to_list()) + 1j * np.concatenate(im.to_list())
            np.add.at(lines, (owner, np.concatenate(at.to_list())), cells)
        result = np.ascontiguousarray(transform(lines))
        return pd.DataFrame({"re": list(result.real), "im": list(result.imag)})

    carry = carry or {}
    lines = df.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(pos).alias("at"), "re", "im")).alias("_cells"),
        *[value.alias(name) for name, value in carry.items()],
    )
    done = lines.select(
        *keys,
        *carry,
        mapped("_cells.at", "_cells.re", "_cells.im").alias("_line"),
    )
    return done.select(
        *keys,
        *carry,
        F.posexplode(F.arrays_zip("_line.re", "_line.im")).alias(out, "_cell"),
    ).select(
        *keys,
        *carry,
        out,
        F.col("_cell.re").alias("re"),
        F.col("_cell.im").alias("im"),
    )


def _fft(lines: np.ndarray) -> np.ndarray:
    return np.fft.fft(lines, axis=1)


def _ifft(lines: np.ndarray) -> np.ndarray:
    return np.fft.ifft(lines, axis=1)


def spectrum_2d(
    pixels: DataFrame, n_rows: int, n_cols: int, unique: bool = False
) -> DataFrame:
    """Unshifted transform: (measurement_id, u, v, re, im), u along rows.

    Rows of the same pixel add up first, so that a line never holds more than
    ``n_cols`` cells; ``unique`` says there are none (as from an image cell).
    """
    value = F.col("value").cast("double")
    place = [ID, "row_idx", "col_idx"]
    cells = (
        pixels.select(*place, value.alias("re"))
        if unique
        else pixels.groupBy(*place).agg(F.sum(value).alias("re"))
    ).withColumn("im", F.lit(0.0))
    lines = along_axis(cells, [ID, "row_idx"], "col_idx", n_cols, _fft, "v")
    return along_axis(lines, [ID, "v"], "row_idx", n_rows, _fft, "u")


def inverse_2d(spectrum: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Real part of the inverse transform, as pixel rows."""
    lines = along_axis(spectrum, [ID, "u"], "v", n_cols, _ifft, "col_idx")
    cells = along_axis(lines, [ID, "col_idx"], "u", n_rows, _ifft, "row_idx")
    return cells.select(ID, "row_idx", "col_idx", F.col("re").alias("value"))


def shifted_index(at: Column, n: int) -> Column:
    """Position after moving the zero frequency to the middle."""
    return (at + n // 2) % n


def frequency(at: Column, n: int) -> Column:
    """Cycles per sample of an unshifted index."""
    return F.when(at < (n + 1) // 2, at).otherwise(at - n) / float(n)


def image_spectrum(
    pixels: DataFrame,
    n_rows: int,
    n_cols: int,
    remove_beam: str = "false",
    thresh: float = 700.0,
    padding: int = 0,
    mask: DataFrame | None = None,
    filter_radius: float | None = None,
    unique: bool = False,
) -> DataFrame:
    """Spectrum of each image, shifted indices ``u``/``v``, with ``norm``, the
    magnitude of the zero frequency used to normalize.

    Removal of the beam (the bounding box of bright pixels, or image times
    mask) is linear, so both ways subtract it in real space; removal in Fourier
    space keeps the norm of the untouched image.
    """
    remove_beam = remove_beam.lower()
    if remove_beam not in {"false", "real", "fourier"}:
        raise ValueError(f"unknown beam removal {remove_beam!r}")
    original = pixels
    if remove_beam != "false":
        if mask is not None:
            listed = mask.select("row_idx", "col_idx", "m")
            beam = F.col("value") * F.coalesce("m", F.lit(0.0))
            at = ["row_idx", "col_idx"]
            pixels = attach(pixels, listed, at, [ID], how="left").withColumn(
                "value", F.col("value") - beam
            )
        else:
            boxed = beam_box(pixels, thresh, padding, n_rows, n_cols)
            pixels = boxed.withColumn("value", F.col("value") - F.col("beam"))
    normed = original if remove_beam == "fourier" else pixels
    norm = normed.groupBy(ID).agg(F.abs(F.sum("value")).alias("norm"))
    spectrum = spectrum_2d(pixels, n_rows, n_cols, unique).withColumns(
        {
            "u": shifted_index(F.col("u"), n_rows),
            "v": shifted_index(F.col("v"), n_cols),
        }
    )
    if filter_radius is not None:
        far = (
            F.pow(F.col("v") - n_cols // 2, 2) + F.pow(F.col("u") - n_rows // 2, 2)
        ) > float(filter_radius) ** 2
        spectrum = spectrum.withColumns(
            {c: F.when(far, 0.0).otherwise(F.col(c)) for c in ("re", "im")}
        )
    return attach(spectrum, norm, [ID], ["u", "v"])


# Parts below this share of the norm are round-off and count as 0 in a phase.
PHASE_FLOOR = 1e-9


def spectrum_features(spectrum: DataFrame) -> DataFrame:
    """Features per frequency; columns not selected later are pruned."""
    magnitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    floor = PHASE_FLOOR * (F.col("norm") + 1.0)

    def solid(name: str) -> Column:
        return F.when(F.abs(name) < floor, F.lit(0.0)).otherwise(F.col(name))

    return spectrum.select(
        ID,
        "u",
        "v",
        F.struct("re", "im").alias("fft2_shifted"),
        F.col("re").alias("fft2_real"),
        F.col("im").alias("fft2_imag"),
        magnitude.alias("fft2_magnitude"),
        F.try_divide(magnitude, F.col("norm")).alias("fft2_norm_magnitude"),
        F.atan2(solid("im"), solid("re")).alias("fft2_phase"),
    )


def vertical_profile(features: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Normalized magnitude along the central column, with its frequency axis."""
    return features.filter(F.col("v") == n_cols // 2).select(
        ID,
        F.col("u").alias("pos"),
        ((F.col("u") - n_rows // 2) / float(n_rows)).alias("fft2_freq_vertical"),
        F.col("fft2_norm_magnitude").alias("fft2_vertical_profile"),
    )


def horizontal_profile(features: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Normalized magnitude along the central row, with its frequency axis."""
    return features.filter(F.col("u") == n_rows // 2).select(
        ID,
        F.col("v").alias("pos"),
        ((F.col("v") - n_cols // 2) / float(n_cols)).alias("fft2_freq_horizontal"),
        F.col("fft2_norm_magnitude").alias("fft2_horizontal_profile"),
    )


def reconstructed(spectrum: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Image rebuilt from a shifted, possibly filtered spectrum."""
    plain = spectrum.select(
        ID,
        ((F.col("u") + (n_rows + 1) // 2) % n_rows).alias("u"),
        ((F.col("v") + (n_cols + 1) // 2) % n_cols).alias("v"),
        "re",
        "im",
    )
    return inverse_2d(plain, n_rows, n_cols)


def percent_deviation(cake: DataFrame, skip_bins: int = 0) -> DataFrame:
    """Deviation of non-zero cake bins from the mean of their column, percent."""
    rows = cake.filter((F.col("pos") >= skip_bins) & (F.col("intensity") != 0))
    means = rows.groupBy(ID, "pos").agg(F.avg("intensity").alias("_mean"))
    return (
        rows.join(means, [ID, "pos"])
        .filter(F.col("_mean") != 0)
        .select(
            ID,
            F.col("chi_bin").alias("row_idx"),
            (F.col("pos") - skip_bins).alias("col_idx"),
            ((F.col("intensity") - F.col("_mean")) / F.col("_mean") * 100).alias(
                "value"
            ),
        )
    )


def roughness(
    cake: DataFrame,
    npt: int,
    npt_azim: int,
    cutoff: float = 0.25,
    skip_bins: int = 0,
) -> DataFrame:
    """Share of spectral power above a frequency cutoff, in percent.

    Subtracting the grand mean only clears the zero frequency, so that
    frequency is left out instead.
    """
    n_q = npt - skip_bins
    spectrum = spectrum_2d(
        percent_deviation(cake, skip_bins), npt_azim, n_q, unique=True
    )
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    radius = F.sqrt(
        F.pow(frequency(F.col("v"), n_q), 2)
        + F.pow(frequency(F.col("u"), npt_azim), 2)
    )
    sums = (
        spectrum.filter((F.col("u") != 0) | (F.col("v") != 0))
        .groupBy(ID)
        .agg(
            F.sum(F.when(radius > cutoff, power).otherwise(0.0)).alias("_high"),
            F.sum(power).alias("_all"),
        )
    )
    share = F.when(F.col("_all") > 0, F.col("_high") / F.col("_all") * 100)
    everyone = cake.select(ID).distinct()
    return everyone.join(sums, ID, "left").select(
        ID, F.coalesce(share, F.lit(0.0)).alias("goodness")
    )


def hankel(
    cake: DataFrame, npt: int, start_radius: int = 0, order: int = 0
) -> DataFrame:
    """Discrete Hankel transform along q of every azimuth line of a cake that
    carries ``q_max``, the q of its last column."""
    n = npt - start_radius
    kernel = hankel_kernel(order, n)
    cells = cake.filter(F.col("pos") >= start_radius).select(
        ID,
        "chi_bin",
        (F.col("pos") - start_radius).alias("pos"),
        F.col("intensity").alias("re"),
        F.lit(0.0).alias("im"),
        "q_max",
    )
    lines = along_axis(
        cells,
        [ID, "chi_bin"],
        "pos",
        n,
        lambda f: f @ kernel.T,
        "m",
        {"q_max": F.max("q_max")},
    )
    return lines.select(
        ID,
        "chi_bin",
        "m",
        (F.col("re") * F.col("q_max") * F.col("q_max")).alias("hankel"),
    )
