"""Operators on measurement tables in the array layout.

Each function takes one row per measurement (with ``measurement_id``), expands
the image inside its task, reduces it with an operator and joins the small
result back to the metadata. The image column itself is dropped unless
``keep_image`` is set, so images are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.layout import collect_image, dense_profile, explode_image
from ..operators import calibration, deviation, image, integrate, spectrum
from ..operators.clean import drop_uncalibrated
from ..operators.integrate import ID

IMAGE = "measurement_data"


def calibrated(
    df: DataFrame,
    mode: str = "dataframe",
    thickness_adjustment: bool = False,
    thickness_adjustment_distance: float = 700.0,
) -> DataFrame:
    """Calibration columns from metadata columns or from the text of each row."""
    if mode == "dataframe":
        return calibration.from_columns(df)
    if mode != "poni":
        raise ValueError(f"unknown calibration mode {mode!r}")
    df = calibration.parse_text(drop_uncalibrated(df))
    if thickness_adjustment:
        df = df.withColumn(
            "distance_m",
            calibration.thickness_distance(
                F.col("thickness"), thickness_adjustment_distance
            ),
        )
    return df


CALIBRATION = ["distance_m", "poni1", "poni2", "pixel1", "pixel2", "wavelength_nm"]


def _shape(column: str) -> tuple[Column, Column]:
    return F.size(column), F.size(F.get(column, F.lit(0)))


def pixel_rows(df: DataFrame, column: str = IMAGE) -> DataFrame:
    """Geometry frame of all pixels with the q range of each row: its own
    ``interpolation_q_range`` where given, else that of the detector."""
    framed = calibration.full_q_range(df, *_shape(column))
    if "interpolation_q_range" in df.columns:
        framed = framed.withColumns(
            {
                "q_lo": F.coalesce("interpolation_q_range.q_min", "q_lo"),
                "q_hi": F.coalesce("interpolation_q_range.q_max", "q_hi"),
            }
        )
    extra = ["azimuthal_range"] if "azimuthal_range" in df.columns else []
    tilts = [t for t in calibration.TILTS if t in df.columns]
    rows = explode_image(
        framed.select(ID, *CALIBRATION, *tilts, "q_lo", "q_hi", *extra, column), column
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    geo = calibration.with_geometry(rows)
    if extra:
        limits = F.col("azimuthal_range")
        geo = geo.filter(
            limits.isNull()
            | F.col("chi").between(limits.getField("start"), limits.getField("end"))
        )
    return geo


def _joined(df: DataFrame, column: str, results: list[DataFrame], keep_image: bool):
    drop = [] if keep_image else [column]
    new = {c for r in results for c in r.columns if c != ID}
    out = df.drop(*drop, *[c for c in new if c in df.columns])
    for result in results:
        out = out.join(result, ID, "left")
    return out


def integration(
    df: DataFrame,
    column: str = IMAGE,
    npt: int = 256,
    mode: str = "1D",
    calibration_mode: str = "dataframe",
    faulty_pixels: list | None = None,
    thickness_adjustment: bool = False,
    thickness_adjustment_distance: float = 700.0,
    thres: float = 3.0,
    max_iter: int = 5,
    calc_cake_stats: bool = False,
    angles: list | None = None,
    npt_azim: int = 360,
    keep_image: bool = False,
) -> DataFrame:
    """Profiles or cakes as array columns, by mode 1D, sigma_clip, 2D or
    rotating_angles."""
    ready = calibrated(
        df, calibration_mode, thickness_adjustment, thickness_adjustment_distance
    )
    geo = pixel_rows(ready, column)
    geo = integrate.mask_pixels(geo, [tuple(p) for p in faulty_pixels or []])
    base = calibration.with_center(ready).withColumn(
        "calculated_distance", F.col("distance_m")
    ).drop(*CALIBRATION)
    values = {
        "intensity": "radial_profile_data",
        "sem": "radial_sem",
        "std": "radial_std",
    }
    if mode in {"1D", "sigma_clip"}:
        rows = (
            integrate.integrate_1d(geo, npt)
            if mode == "1D"
            else integrate.sigma_clip(geo, npt, thres, max_iter)
        )
        results = [dense_profile(rows, [ID], npt, values, "q_range")]
    elif mode == "2D":
        cake = integrate.integrate_2d(geo, npt, npt_azim)
        positions = F.array(
            *[F.lit(-180 + (i + 0.5) * 360.0 / npt_azim) for i in range(npt_azim)]
        )
        image_cells = collect_image(
            cake.select(
                ID,
                F.col("chi_bin").alias("row_idx"),
                F.col("pos").alias("col_idx"),
                "intensity",
            ),
            [ID],
            npt_azim,
            npt,
            "intensity",
            "radial_profile_data",
        )
        axis = cake.groupBy(ID).agg(
            F.max("q_first").alias("_a"), F.max("q_step").alias("_b")
        ).select(
            ID,
            F.transform(
                F.sequence(F.lit(0), F.lit(npt - 1)),
                lambda p: F.col("_a") + (p + 0.5) * F.col("_b"),
            ).alias("q_range"),
            positions.alias("azimuthal_positions"),
        )
        results = [axis, image_cells]
        if calc_cake_stats:
            stats = integrate.cake_stats(cake)
            names = [c for c in stats.columns if c.startswith("cake_")]
            cells = stats.groupBy(ID).agg(
                F.map_from_entries(
                    F.collect_list(F.struct("pos", F.struct(*names)))
                ).alias("_m")
            )
            results.append(
                cells.select(
                    ID,
                    *[
                        F.transform(
                            F.sequence(F.lit(0), F.lit(npt - 1)),
                            _picker("_m", n),
                        ).alias(n)
                        for n in names
                    ],
                )
            )
    elif mode == "rotating_angles":
        pairs = [tuple(a) for a in angles or []]
        rows = integrate.rotating_angles(geo, pairs, npt)
        results = []
        for number, (start, end) in enumerate(pairs):
            label = f"{start}_{end}"
            results.append(
                dense_profile(
                    rows.filter(F.col("range_no") == number),
                    [ID],
                    npt,
                    {
                        "intensity": f"radial_profile_data_{label}",
                        "sigma": f"sigma_{label}",
                        "std": f"std_{label}",
                    },
                    f"q_range_{label}",
                )
            )
    else:
        raise ValueError(f"unknown integration mode {mode!r}")
    return _joined(base, column, results, keep_image)


def _picker(cells: str, field: str):
    return lambda p: F.try_element_at(F.col(cells), p).getField(field)


def deviations(
    df: DataFrame,
    faulty_pixels: list | None = None,
    npt: int = 256,
    above_limits: list | tuple = (1.2,),
    below_limits: list | tuple = (0.8,),
    mode: str = "cake",
    shape: tuple[int, int] = (256, 256),
    npt_azim: int = 360,
    keep_image: bool = False,
) -> DataFrame:
    """``deviation_*`` arrays and ``image_*`` (in cake mode also ``cake_*``)
    cells per limit. Faulty pixels only matter to a cake: ring means use all."""
    ready = calibrated(df, "poni")
    geo = pixel_rows(ready)
    sides = [("above", x) for x in above_limits] + [("below", x) for x in below_limits]
    names = [f"{side}_{float(limit)}" for side, limit in sides]
    n_rows, n_cols = shape
    results = []
    if mode == "cake":
        geo = integrate.mask_pixels(geo, [tuple(p) for p in faulty_pixels or []])
        binned = integrate.with_chi_bin(integrate.with_q_bin(geo, npt), npt_azim)
        cake = integrate.integrate_2d(geo, npt, npt_azim)
        long = deviation.cake_deviation(cake, npt_azim, above_limits, below_limits)
        flags = deviation.cake_flags(cake, above_limits, below_limits)
        images = deviation.project_back(binned, flags)
        key, length = "pos", npt
        for n in names:
            cells = flags.select(
                ID,
                F.col("chi_bin").alias("row_idx"),
                F.col("pos").alias("col_idx"),
                F.col(f"`cake_{n}`").alias("value"),
            )
            results.append(
                collect_image(cells, [ID], npt_azim, npt, "value", f"cake_{n}")
            )
    else:
        long = deviation.deviation(geo, above_limits, below_limits, npt)
        images = deviation.deviation_images(geo, above_limits, below_limits, npt)
        key, length = "digit", npt + 1
    for n in names:
        cells = images.select(
            ID, "row_idx", "col_idx", F.col(f"`image_{n}`").alias("value")
        )
        results.append(collect_image(cells, [ID], n_rows, n_cols, "value", f"image_{n}"))
    wide = deviation.deviation_wide(long, key, above_limits, below_limits)
    packed = wide.groupBy(ID).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    key,
                    F.struct(
                        *[
                            F.col(f"`deviation_{n}`").alias(f"d{i}")
                            for i, n in enumerate(names)
                        ]
                    ),
                )
            )
        ).alias("_m")
    )
    results.append(
        packed.select(
            ID,
            *[
                F.transform(
                    F.sequence(F.lit(0), F.lit(length - 1)), _picker("_m", f"d{i}")
                ).alias(f"deviation_{n}")
                for i, n in enumerate(names)
            ],
        )
    )
    return _joined(ready.drop(*CALIBRATION), IMAGE, results, keep_image)


def cut_rings(df: DataFrame, column: str, distances: list) -> DataFrame:
    """Zero rings around the center, inside each row."""
    if not distances:
        return drop_uncalibrated(df)
    ready = calibration.with_center(calibration.parse_text(drop_uncalibrated(df)))

    def cell(value: Column, row: Column, col: Column) -> Column:
        r = F.sqrt(
            F.pow(col - F.col("center_x"), 2) + F.pow(row - F.col("center_y"), 2)
        )
        inside = F.lit(False)
        for low, high in distances:
            hit = F.lit(True)
            if low is not None:
                hit = hit & (r >= float(low))
            if high is not None:
                hit = hit & (r <= float(high))
            inside = inside | hit
        return F.when(inside, F.lit(0.0)).otherwise(value)

    cut = F.transform(
        column, lambda line, i: F.transform(line, lambda v, j: cell(v, i, j))
    )
    return ready.withColumn(column, cut).select(*df.columns)


def resize(
    df: DataFrame, column: str, ref_distance: float, shape: tuple[int, int]
) -> DataFrame:
    """Rescale images to a reference distance; the text follows. Target sizes
    differ per calibration, so cells come back with the size of their own."""
    ready = calibration.parse_text(df)
    dimension = ready.select(
        F.col(ID).alias("cal_id"), "distance_m"
    )
    rows = explode_image(ready.select(ID, F.col(ID).alias("cal_id"), column), column)
    pixels = image.image_resize(rows, dimension, ref_distance, *shape)
    k = F.lit(ref_distance * 0.001) / F.col("distance_m")
    lines = pixels.groupBy(ID, "row_idx").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "value"))).alias("_l")
    )
    cells = (
        lines.select(ID, "row_idx", F.col("_l.value").alias("_v"))
        .groupBy(ID)
        .agg(F.sort_array(F.collect_list(F.struct("row_idx", "_v"))).alias("_i"))
        .select(ID, F.col("_i._v").alias(column))
    )
    text = calibration.substitute_poni(
        F.col("ponifile"), F.col("poni1") * k, F.col("poni2") * k
    )
    base = ready.withColumn("ponifile", text).select(
        *[c for c in df.columns if c != column]
    )
    return base.join(cells, ID)


def cut_common(
    df: DataFrame, column: str, shape: tuple[int, int], square: bool = False
) -> DataFrame:
    """Crop every image to the region all of them share, inside each row."""
    ready = calibration.with_center(calibration.parse_text(df))
    region = image.common_region(ready, *shape, square=square)
    box = region.select(F.struct(*region.columns)).scalar()
    framed = ready.withColumn("_box", box)

    def corner(center: str, low: str, high: str) -> tuple[Column, Column]:
        first = (F.col(center) - F.col(f"_box.{low}")).cast("int")
        last = (F.col(center) + F.col(f"_box.{high}")).cast("int")
        return first, last - first

    x0, width = corner("center_x", "max_up", "max_down")
    y0, height = corner("center_y", "max_left", "max_right")
    cropped = F.transform(
        F.slice(F.col(column), y0 + 1, height), lambda line: F.slice(line, x0 + 1, width)
    )
    text = calibration.substitute_poni(
        F.col("ponifile"),
        F.col("_box.max_left") * F.col("pixel1"),
        F.col("_box.max_up") * F.col("pixel2"),
    )
    return framed.withColumns({column: cropped, "ponifile": text}).select(*df.columns)


GRID_FEATURES = [
    "fft2_real",
    "fft2_imag",
    "fft2_norm_magnitude",
    "fft2_magnitude",
    "fft2_phase",
]
ALL_FEATURES = [
    "fft2_shifted",
    *GRID_FEATURES,
    "fft2_reconstructed",
    "fft2_vertical_profile",
    "fft2_horizontal_profile",
    "fft2_freq_horizontal",
    "fft2_freq_vertical",
]


def fourier_2d(
    df: DataFrame,
    column: str,
    shape: tuple[int, int],
    features: list[str] | str | None = None,
    remove_beam: str = "false",
    thresh: float = 1000.0,
    padding: int = 0,
    filter_radius: float | None = None,
    mask: DataFrame | None = None,
    keep_image: bool = False,
) -> DataFrame:
    """Requested spectral features as cells; ``fft2_shifted`` comes as its real
    and imaginary grids side by side in a struct."""
    if features is None or features == "all":
        features = ALL_FEATURES
    elif isinstance(features, str):
        features = [features]
    n_rows, n_cols = shape
    pixels = explode_image(df.select(ID, column), column)
    spec = spectrum.image_spectrum(
        pixels,
        n_rows,
        n_cols,
        remove_beam,
        thresh,
        padding,
        mask,
        filter_radius,
        unique=True,
    )
    per_frequency = spectrum.spectrum_features(spec)

    def grid(frame: DataFrame, value: str, name: str) -> DataFrame:
        cells = frame.select(
            ID,
            F.col("u").alias("row_idx"),
            F.col("v").alias("col_idx"),
            F.col(value).alias("value"),
        )
        return collect_image(cells, [ID], n_rows, n_cols, "value", name)

    results, literals = [], {}
    for f in features:
        if f == "fft2_shifted":
            re = grid(per_frequency, "fft2_real", "_re")
            im = grid(per_frequency, "fft2_imag", "_im")
            results.append(
                re.join(im, ID).select(
                    ID,
                    F.struct(F.col("_re").alias("re"), F.col("_im").alias("im")).alias(f),
                )
            )
        elif f in GRID_FEATURES:
            results.append(grid(per_frequency, f, f))
        elif f == "fft2_reconstructed":
            back = spectrum.reconstructed(spec, n_rows, n_cols)
            results.append(collect_image(back, [ID], n_rows, n_cols, "value", f))
        elif f in {"fft2_vertical_profile", "fft2_horizontal_profile"}:
            line = getattr(spectrum, f.removeprefix("fft2_"))(
                per_frequency, n_rows, n_cols
            )
            ordered = F.sort_array(F.collect_list(F.struct("pos", f)))
            results.append(
                line.groupBy(ID)
                .agg(ordered.alias("_l"))
                .select(ID, F.col(f"_l.{f}").alias(f))
            )
        elif f in {"fft2_freq_horizontal", "fft2_freq_vertical"}:
            n = n_cols if f.endswith("horizontal") else n_rows
            literals[f] = F.array(*[F.lit((i - n // 2) / n) for i in range(n)])
    return _joined(df, column, results, keep_image).withColumns(literals)


def cake_rows(df: DataFrame, column: str) -> DataFrame:
    """Cake cells to rows; ``q_max`` from the q axis where the table has one."""
    cols = [ID, column] + (["q_range"] if "q_range" in df.columns else [])
    rows = explode_image(df.select(*cols), column)
    out = rows.select(
        ID,
        F.col("row_idx").alias("chi_bin"),
        F.col("col_idx").alias("pos"),
        F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("intensity"),
        *([F.array_max("q_range").alias("q_max")] if "q_range" in df.columns else []),
    )
    return out


def hankel_cells(
    df: DataFrame, column: str, shape: tuple[int, int], start_radius: int = 0, order: int = 0
) -> DataFrame:
    if column not in df.columns or "q_range" not in df.columns:
        raise ValueError(f"need the columns {column} and q_range")
    n_azim, npt = shape
    rows = spectrum.hankel(cake_rows(df, column), npt, start_radius, order).select(
        ID,
        F.col("chi_bin").alias("row_idx"),
        F.col("m").alias("col_idx"),
        F.col("hankel").alias("value"),
    )
    cells = collect_image(rows, [ID], n_azim, npt - start_radius, "value", "hankel")
    return df.join(cells, ID, "left")


def goodness(
    df: DataFrame,
    column: str,
    shape: tuple[int, int],
    threshold: float = 0.25,
    start_radius: int = 0,
) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    n_azim, npt = shape
    rows = spectrum.roughness(
        cake_rows(df, column), npt, n_azim, threshold, start_radius
    )
    return df.join(rows, ID, "left")
