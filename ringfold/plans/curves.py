"""Registered queries over profiles, spectra and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import tidy
from ..functions.layout import collect_image, collect_profile
from ..functions.special import hankel_kernel
from ..operators import profile, scale, spectrum
from ..sources import adapters
from ..sources.adapters import N_COLS, N_ROWS
from . import images
from .images import AZIM, ID, NPT
from .oracle import NUDGE, with_tables

ORDER = 15
CURVE = "radial_profile_data"


def _points(df, column, name, *rest):
    """Array cells as rounded long rows."""
    return df.select(
        ID, *rest, F.posexplode(column).alias("pos", name)
    ).select(ID, *rest, F.col("pos").cast("long").alias("pos"), tidy(name).alias(name))


def slope_removal(spark, d):
    df = adapters.profile_arrays(spark, d)
    return _points(
        df.withColumn("y", profile.slope_removed(F.col(CURVE))), "y", "intensity"
    )


ENDS = """
, ends as (
    select measurement_id, max(n_points) as n, arg_min(intensity, pos) as y0,
           arg_max(intensity, pos) as y1 from profiles group by 1)
"""

SLOPE = with_tables(
    "profiles",
    ENDS
    + """
select measurement_id, pos,
       round(intensity - y0 - (y1 - y0) * pos / (n - 1), 6) + 0.0 as intensity
from profiles join ends using (measurement_id)""",
)


def slope_removal_rotate(spark, d):
    df = adapters.profile_arrays(spark, d).withColumn(
        "_r", profile.slope_rotated(F.col(CURVE))
    )
    return df.select(
        ID, F.posexplode(F.arrays_zip("_r.y", "_r.x")).alias("pos", "c")
    ).select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        tidy(F.col("c.y")).alias("y"),
        tidy(F.col("c.x")).alias("x"),
    )


SLOPE_ROTATE = with_tables(
    "profiles",
    ENDS
    + """
, t as (select *, atan((y1 - y0) / (n - 1)) as a from ends)
select measurement_id, pos,
       round((intensity - y0) * cos(a) - pos * sin(a), 6) + 0.0 as y,
       round(pos * cos(a) + (intensity - y0) * sin(a), 6) + 0.0 as x
from profiles join t using (measurement_id)""",
)


def _coefficients(spark, d, mode, first, second):
    coefs = profile.fourier_coefficients(adapters.profiles(spark, d), ORDER, mode)
    return profile.coefficients_long(coefs, first, second).select(
        ID,
        F.col("n").cast("long").alias("n"),
        tidy(first).alias(first),
        tidy(second).alias(second),
    )


def fourier_simpson(spark, d):
    return _coefficients(spark, d, "custom", "a", "b")


def fourier_dft(spark, d):
    return _coefficients(spark, d, "fft", "re", "im")


# Weights are summed interval by interval here: pairs of intervals by the
# parabola rule, the odd last interval by the parabola through its last points.
SIMPSON = """
, base as (
    select distinct n_points as n, p as pos from profiles, unnest(generate_series(0, n_points - 1)) t(p))
, pairs as (
    select n, s from (select distinct n from base), unnest(generate_series(0, n - 3, 2)) t(s))
, w as (
    select n, pos, sum(w) as w from (
        select n, s as pos, 1.0::double / 3 as w from pairs
        union all select n, s + 1, 4.0::double / 3 from pairs
        union all select n, s + 2, 1.0::double / 3 from pairs
        union all select distinct n, n - 1, 5.0::double / 12 from base where n % 2 = 0
        union all select distinct n, n - 2, 8.0::double / 12 from base where n % 2 = 0
        union all select distinct n, n - 3, -1.0::double / 12 from base where n % 2 = 0)
    group by all)
, coefs as (
    select measurement_id, k, any_value(n_points) as n,
           2 * sum(intensity * w * cos(2 * pi() * k * pos / (n_points - 1))) / max(n_points - 1) as a,
           2 * sum(intensity * w * sin(2 * pi() * k * pos / (n_points - 1))) / max(n_points - 1) as b
    from profiles join w on w.n = n_points and w.pos = profiles.pos, range(0, 16) t(k)
    group by measurement_id, k)
"""
SIMPSON = SIMPSON.replace("k * pos", "k * profiles.pos")

DFT = """
, coefs as (
    select measurement_id, k, any_value(n_points) as n,
           sum(intensity * cos(2 * pi() * k * pos / n_points)) as a,
           -sum(intensity * sin(2 * pi() * k * pos / n_points)) as b
    from profiles, range(0, 16) t(k) group by measurement_id, k)
"""

COEFS = """
select measurement_id, k as n, round(a, 6) + 0.0 as {a}, round(b, 6) + 0.0 as {b}
from coefs where k > 0"""


def _inverse(spark, d, mode):
    rows = profile.fourier_inverse(adapters.profiles(spark, d), ORDER, mode)
    return rows.select(
        ID, F.col("pos").cast("long").alias("pos"), tidy("inverse").alias("inverse")
    )


def fourier_simpson_inverse(spark, d):
    return _inverse(spark, d, "custom")


def fourier_dft_inverse(spark, d):
    return _inverse(spark, d, "fft")


SIMPSON_INVERSE = """
select p.measurement_id, p.pos,
       round(sum(case when k = 0 then a / 2 else
           a * cos(2 * pi() * k * pos / (n - 1)) + b * sin(2 * pi() * k * pos / (n - 1)) end), 6) as inverse
from profiles p join coefs using (measurement_id) group by 1, 2"""

DFT_INVERSE = """
select p.measurement_id, p.pos,
       round(sum(case when k = 0 then a else
           2 * (a * cos(2 * pi() * k * pos / n) - b * sin(2 * pi() * k * pos / n)) end)
           / any_value(n), 6) as inverse
from profiles p join coefs using (measurement_id) group by 1, 2"""


def fourier_apply(spark, d):
    """Both columns of the array layout, series mode; coefficients and inverse."""
    df = profile.fourier_cells(
        adapters.profile_arrays(spark, d), [CURVE, "q_range"], ORDER, "custom"
    )
    kinds = [
        ("coefficients", f"fourier_coefficients_{CURVE}"),
        ("inverse", f"fourier_inverse_{CURVE}"),
        ("coefficients_q", "fourier_coefficients_q_range"),
        ("inverse_q", "fourier_inverse_q_range"),
    ]
    entries = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("cells")) for k, c in kinds]
    )
    rows = df.select(ID, F.explode(entries).alias("_e")).select(
        ID, F.col("_e.kind").alias("kind"), F.posexplode("_e.cells").alias("pos", "value")
    )
    return rows.select(
        ID,
        "kind",
        F.col("pos").cast("long").alias("pos"),
        tidy(F.col("value") + NUDGE).alias("value"),
    )


FOURIER_APPLY = with_tables(
    "profiles",
    SIMPSON
    + f"""
, coefs_q as (
    select measurement_id, k, any_value(n_points) as n,
           2 * sum(q * w * cos(2 * pi() * k * profiles.pos / (n_points - 1))) / max(n_points - 1) as a,
           2 * sum(q * w * sin(2 * pi() * k * profiles.pos / (n_points - 1))) / max(n_points - 1) as b
    from profiles join w on w.n = n_points and w.pos = profiles.pos, range(0, 16) t(k)
    group by measurement_id, k)
, rebuilt as (
    select p.measurement_id, p.pos,
           sum(case when c.k = 0 then c.a / 2 else c.a * cos(2 * pi() * c.k * pos / (c.n - 1))
               + c.b * sin(2 * pi() * c.k * pos / (c.n - 1)) end) as y,
           sum(case when c.k = 0 then cq.a / 2 else cq.a * cos(2 * pi() * c.k * pos / (c.n - 1))
               + cq.b * sin(2 * pi() * c.k * pos / (c.n - 1)) end) as yq
    from profiles p join coefs c using (measurement_id)
         join coefs_q cq on cq.measurement_id = p.measurement_id and cq.k = c.k group by 1, 2)
select measurement_id, kind, pos, round(value + {NUDGE}, 6) as value from (
    select measurement_id, 'coefficients' as kind, k - 1 as pos, a as value from coefs where k > 0
    union all select measurement_id, 'coefficients', k + 14, b from coefs where k > 0
    union all select measurement_id, 'inverse', pos, y from rebuilt
    union all select measurement_id, 'coefficients_q', k - 1, a from coefs_q where k > 0
    union all select measurement_id, 'coefficients_q', k + 14, b from coefs_q where k > 0
    union all select measurement_id, 'inverse_q', pos, yq from rebuilt)""",
)


def _features(spark, d, **options):
    spec = spectrum.image_spectrum(
        adapters.pixels(spark, d), N_ROWS, N_COLS, **options
    )
    return spectrum.spectrum_features(spec).select(
        ID,
        F.col("u").cast("long").alias("u"),
        F.col("v").cast("long").alias("v"),
        *[
            tidy(c, 5).alias(c)
            for c in (
                "fft2_real",
                "fft2_imag",
                "fft2_magnitude",
                "fft2_norm_magnitude",
                "fft2_phase",
            )
        ],
    )


def fft2_features(spark, d):
    return _features(spark, d)


def fft2_beam_removal(spark, d):
    return _features(spark, d, remove_beam="fourier", thresh=140.0, padding=1)


def fft2_beam_removal_real(spark, d):
    return _features(spark, d, remove_beam="real", thresh=140.0, padding=1)


def fft2_radius_filter(spark, d):
    spec = spectrum.image_spectrum(
        adapters.pixels(spark, d), N_ROWS, N_COLS, filter_radius=6.0
    )
    return spectrum.reconstructed(spec, N_ROWS, N_COLS).select(
        ID, "row_idx", "col_idx", tidy(F.col("value") + NUDGE, 5).alias("value")
    )


def fft2_reconstruction(spark, d):
    spec = spectrum.image_spectrum(adapters.pixels(spark, d), N_ROWS, N_COLS)
    return spectrum.reconstructed(spec, N_ROWS, N_COLS).select(
        ID, "row_idx", "col_idx", tidy("value", 5).alias("value")
    )


def fft2_profiles(spark, d):
    features = spectrum.spectrum_features(
        spectrum.image_spectrum(adapters.pixels(spark, d), N_ROWS, N_COLS)
    )
    down = spectrum.vertical_profile(features, N_ROWS, N_COLS)
    across = spectrum.horizontal_profile(features, N_ROWS, N_COLS)
    return down.join(across, [ID, "pos"]).select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        *[
            tidy(c).alias(c)
            for c in (
                "fft2_freq_vertical",
                "fft2_vertical_profile",
                "fft2_freq_horizontal",
                "fft2_horizontal_profile",
            )
        ],
    )


# Direct sums in two steps, over centred frequencies f = index - 16.
FFT2 = """
, img as (select measurement_id, row_idx as r, col_idx as c, {value} as x from {source})
, norms as (select measurement_id, abs(sum({norm})) as norm from {source} group by 1)
, lines as (
    select measurement_id, r, f as g,
           sum(x * cos(2 * pi() * f * c / 32)) as a, -sum(x * sin(2 * pi() * f * c / 32)) as b
    from img, range(-16, 16) t(f) group by all)
, spec as (
    select measurement_id, f + 16 as u, g + 16 as v,
           sum(a * cos(2 * pi() * f * r / 32) + b * sin(2 * pi() * f * r / 32)) as re,
           sum(b * cos(2 * pi() * f * r / 32) - a * sin(2 * pi() * f * r / 32)) as im
    from lines, range(-16, 16) t(f) group by all)
"""

FEATURES = """
select measurement_id, u, v, round(re, 5) + 0.0 as fft2_real, round(im, 5) + 0.0 as fft2_imag,
       round(sqrt(re * re + im * im), 5) as fft2_magnitude,
       round(sqrt(re * re + im * im) / norm, 5) as fft2_norm_magnitude,
       round(atan2(case when abs(im) < 1e-9 * (norm + 1) then 0 else im end,
                   case when abs(re) < 1e-9 * (norm + 1) then 0 else re end), 5) + 0.0 as fft2_phase
from spec join norms using (measurement_id)"""

BEAM = """
, box as (
    select measurement_id, min(row_idx) - 1 as r0, max(row_idx) + 1 as r1,
           min(col_idx) - 1 as c0, max(col_idx) + 1 as c1
    from pixels where value > 140 group by 1)
, cleaned as (
    select p.*, case when row_idx between r0 and r1 and col_idx between c0 and c1
                     then 0 else value end as rest
    from pixels p left join box using (measurement_id))
"""


def _fft2_sql(tail: str, source="pixels", value="value", norm="value", extra="") -> str:
    return with_tables(
        "pixels", extra + FFT2.format(source=source, value=value, norm=norm) + tail
    )


FFT2_PROFILES = _fft2_sql(
    """
, mag as (
    select measurement_id, u, v, sqrt(re * re + im * im) / norm as m
    from spec join norms using (measurement_id))
select a.measurement_id, a.u as pos, round((a.u - 16) / 32, 6) as fft2_freq_vertical,
       round(a.m, 6) as fft2_vertical_profile, round((b.v - 16) / 32, 6) as fft2_freq_horizontal,
       round(b.m, 6) as fft2_horizontal_profile
from mag a join mag b on a.measurement_id = b.measurement_id and a.u = b.v
where a.v = 16 and b.u = 16"""
)

FFT2_RECONSTRUCTION = with_tables(
    "pixels",
    """
select m.measurement_id, r::int as row_idx, c::int as col_idx, round(coalesce(value, 0), 5) as value
from (select distinct measurement_id from pixels) m cross join range(0, 32) a(r)
     cross join range(0, 32) b(c)
     left join pixels p on p.measurement_id = m.measurement_id and p.row_idx = r and p.col_idx = c""",
)

FFT2_FILTER = _fft2_sql(
    f"""
, near as (select measurement_id, u - 16 as f, v - 16 as g, re, im from spec
           where (u - 16) ** 2 + (v - 16) ** 2 <= 36)
select measurement_id, r::int as row_idx, c::int as col_idx,
       round(sum(re * cos(2 * pi() * (f * r + g * c) / 32)
                 - im * sin(2 * pi() * (f * r + g * c) / 32)) / 1024 + {NUDGE}, 5) as value
from near, range(0, 32) a(r), range(0, 32) b(c) group by all"""
)


def roughness(spark, d):
    out = spectrum.roughness(images._cake(spark, d), NPT, AZIM, 0.25, 4)
    return out.select(ID, tidy("goodness").alias("goodness"))


ROUGHNESS = with_tables(
    "geo",
    images.CAKE
    + f"""
, dev as (
    select measurement_id, chi_bin as r, pos - 4 as c, (intensity - mu) / mu * 100 as x
    from (select *, avg(intensity) over (partition by measurement_id, pos) as mu
          from cake where pos >= 4 and intensity <> 0))
, grand as (select measurement_id, sum(x) / ({AZIM} * {NPT - 4}) as g from dev group by 1)
, dense as (
    select m.measurement_id, a.r, b.c, coalesce(x, 0) - g as x
    from grand m cross join range(0, {AZIM}) a(r) cross join range(0, {NPT - 4}) b(c)
    left join dev on dev.measurement_id = m.measurement_id and dev.r = a.r and dev.c = b.c)
, lines as (
    select measurement_id, r, f as g, sum(x * cos(2 * pi() * f * c / {NPT - 4})) as a,
           -sum(x * sin(2 * pi() * f * c / {NPT - 4})) as b
    from dense, range({-(NPT - 4) // 2}, {(NPT - 4) // 2}) t(f) group by all)
, spec as (
    select measurement_id, f, g,
           sum(a * cos(2 * pi() * f * r / {AZIM}) + b * sin(2 * pi() * f * r / {AZIM})) as re,
           sum(b * cos(2 * pi() * f * r / {AZIM}) - a * sin(2 * pi() * f * r / {AZIM})) as im
    from lines, range({-AZIM // 2}, {AZIM // 2}) t(f) group by all)
select measurement_id, round(sum(case when
           sqrt((g / {NPT - 4}) ** 2 + (f / {AZIM}) ** 2) > 0.25 then re * re + im * im else 0 end)
           / sum(re * re + im * im) * 100, 6) as goodness
from spec group by measurement_id""",
)


def hankel(spark, d):
    out = spectrum.hankel(images._cake(spark, d), NPT, 4, 0)
    return out.select(
        ID,
        F.col("chi_bin").cast("long").alias("chi_bin"),
        F.col("m").cast("long").alias("m"),
        tidy("hankel", 5).alias("hankel"),
    )


def _hankel_sql() -> str:
    kernel = hankel_kernel(0, NPT - 4)
    values = ", ".join(
        f"({m}, {n}, {kernel[m, n]!r}::double)".replace("np.float64(", "").replace(")::", "::")
        for m in range(NPT - 4)
        for n in range(NPT - 4)
    )
    return with_tables(
        "geo",
        images.CAKE
        + f"""
, kernel(m, n, k) as (values {values})
, radius as (
    select measurement_id, max(q_lo) + ({NPT} - 0.5::double) * (max(q_hi) - max(q_lo)) / {NPT} as rmax
    from binned group by 1)
select measurement_id, chi_bin, m::bigint as m,
       round(any_value(rmax) ** 2 * sum(k * intensity), 5) + 0.0 as hankel
from cake join kernel on n = pos - 4 join radius using (measurement_id)
group by measurement_id, chi_bin, m""",
    )


def _normalize(norm):
    def run(spark, d):
        df = adapters.profile_arrays(spark, d)
        return _points(
            df.withColumn("y", scale.normalized(F.col(CURVE), norm)), "y", "intensity"
        )

    return run


def _normalize_sql(measure: str) -> str:
    return with_tables(
        "profiles",
        f"""
select measurement_id, pos, round(intensity / {measure} over (partition by measurement_id), 6) as intensity
from profiles""",
    )


def normalize_image(spark, d):
    return scale.normalize_image(adapters.pixels(spark, d), "l2").select(
        ID, "row_idx", "col_idx", tidy("value").alias("value")
    )


NORMALIZE_IMAGE = with_tables(
    "pixels",
    """
select measurement_id, row_idx, col_idx,
       round(value / sqrt(sum(value * value) over (partition by measurement_id)), 6) as value
from pixels""",
)


def column_standardize(spark, d):
    df = scale.standardize(adapters.profile_arrays(spark, d), CURVE)
    return _points(df, CURVE, "intensity")


COLUMN_STANDARDIZE = with_tables(
    "profiles",
    """
select measurement_id, pos, round((intensity - avg(intensity) over (partition by pos))
       / stddev_pop(intensity) over (partition by pos), 6) + 0.0 as intensity
from profiles""",
)


def norm_scale_by_type(spark, d):
    df = scale.norm_scale(adapters.profile_arrays(spark, d), kinds=scale.TYPES)
    return df.select(
        ID,
        "type_measurement",
        F.posexplode(F.arrays_zip(scale.NORM, scale.SCALED)).alias("pos", "c"),
    ).select(
        ID,
        "type_measurement",
        F.col("pos").cast("long").alias("pos"),
        tidy(F.col(f"c.{scale.NORM}"), 8).alias("norm"),
        tidy(F.col(f"c.{scale.SCALED}")).alias("scaled"),
    )


NORM_SCALE = """
, normed as (
    select *, intensity / sum(abs(intensity)) over (partition by measurement_id) as norm
    from profiles)
, scaled as (
    select *, (norm - avg(norm) over (partition by {by}, pos))
              / stddev_pop(norm) over (partition by {by}, pos) as scaled from normed)
"""


def group_statistics(spark, d):
    out = scale.group_statistics(adapters.profiles(spark, d), ["label"])
    return out.select(
        "label",
        F.col("pos").cast("long").alias("pos"),
        tidy("mean").alias("mean"),
        tidy("std").alias("std"),
    )


def group_mean_profile(spark, d):
    out = scale.group_statistics(
        adapters.profiles(spark, d), ["type_measurement", "cancer_diagnosis"]
    )
    return out.select(
        "type_measurement",
        "cancer_diagnosis",
        F.col("pos").cast("long").alias("pos"),
        tidy("q").alias("q"),
        tidy("mean").alias("mean"),
    )


def model_matrix(spark, d):
    df = scale.norm_scale(adapters.profile_arrays(spark, d), kinds=scale.TYPES)
    filled = df.withColumn("age", F.coalesce("age", F.lit(-1.0)))
    return _points(scale.model_matrix(filled), "model_row", "value")


MODEL_MATRIX = with_tables(
    "profiles",
    NORM_SCALE.format(by="type_measurement")
    + """
, sizes as (select patient_id, count(distinct measurement_id) as n from profiles group by 1)
select measurement_id, pos, round(scaled, 6) + 0.0 as value from scaled
union all
select measurement_id, n_points, n::double from profiles join sizes using (patient_id) where pos = 0
union all
select measurement_id, n_points + 1, coalesce(age, -1) from profiles where pos = 0""",
)


def collect_cells(spark, d):
    """Long results back to array cells: profiles and images per measurement."""
    from ..operators import integrate

    profile_rows = integrate.integrate_1d(images.geo(spark, d), NPT)
    cells = collect_profile(
        profile_rows, [ID], "pos", {"q": "q_range", "intensity": CURVE}
    )
    image = collect_image(adapters.pixels(spark, d), [ID], N_ROWS, N_COLS)
    flat = F.flatten("measurement_data")
    both = cells.join(image, ID)
    bins = both.select(
        ID, F.lit("bin").alias("cell"), F.posexplode(F.arrays_zip("q_range", CURVE))
    ).select(ID, "cell", "pos", F.col("col.q_range").alias("q"), F.col(f"col.{CURVE}").alias("value"))
    dots = both.select(
        ID, F.lit("pixel").alias("cell"), F.posexplode(flat).alias("pos", "value")
    ).withColumn("q", F.lit(None).cast("double"))
    return bins.unionByName(dots).select(
        ID, "cell", F.col("pos").cast("long").alias("pos"), tidy("q").alias("q"), tidy("value").alias("value")
    )


COLLECT_CELLS = with_tables(
    "geo",
    images.BINNED
    + f"""
, bins as (
    select measurement_id, pos, avg(value) as v,
           max(q_lo) + (pos + 0.5) * (max(q_hi) - max(q_lo)) / {NPT} as q
    from binned group by measurement_id, pos)
, dense as (
    select m.measurement_id, g.pos as pos, coalesce(p.value, 0) as value
    from (select distinct measurement_id from bins) m
         cross join (select unnest(range({N_ROWS} * {N_COLS})) as pos) g
         left join pixels p on p.measurement_id = m.measurement_id
              and p.row_idx * {N_COLS} + p.col_idx = g.pos)
select measurement_id, 'bin' as cell, row_number() over (partition by measurement_id order by pos) - 1 as pos,
       round(q, 6) + 0.0 as q, round(v, 6) + 0.0 as value from bins
union all
select measurement_id, 'pixel', pos, null, round(value::double, 6) + 0.0 from dense""",
)

QUERIES = {
    "slope_removal": (slope_removal, SLOPE),
    "slope_removal_rotate": (slope_removal_rotate, SLOPE_ROTATE),
    "fourier_simpson": (
        fourier_simpson,
        with_tables("profiles", SIMPSON + COEFS.format(a="a", b="b")),
    ),
    "fourier_dft": (
        fourier_dft,
        with_tables("profiles", DFT + COEFS.format(a="re", b="im")),
    ),
    "fourier_simpson_inverse": (
        fourier_simpson_inverse,
        with_tables("profiles", SIMPSON + SIMPSON_INVERSE),
    ),
    "fourier_dft_inverse": (
        fourier_dft_inverse,
        with_tables("profiles", DFT + DFT_INVERSE),
    ),
    "fourier_apply": (fourier_apply, FOURIER_APPLY),
    "fft2_features": (fft2_features, _fft2_sql(FEATURES)),
    "fft2_profiles": (fft2_profiles, FFT2_PROFILES),
    "fft2_reconstruction": (fft2_reconstruction, FFT2_RECONSTRUCTION),
    "fft2_beam_removal": (
        fft2_beam_removal,
        _fft2_sql(FEATURES, "cleaned", "rest", "value", BEAM),
    ),
    "fft2_beam_removal_real": (
        fft2_beam_removal_real,
        _fft2_sql(FEATURES, "cleaned", "rest", "rest", BEAM),
    ),
    "fft2_radius_filter": (fft2_radius_filter, FFT2_FILTER),
    "roughness": (roughness, ROUGHNESS),
    "hankel": (hankel, _hankel_sql()),
    "normalize_l1": (_normalize("l1"), _normalize_sql("sum(abs(intensity))")),
    "normalize_l2": (
        _normalize("l2"),
        with_tables(
            "profiles",
            """
select measurement_id, pos,
       round(intensity / sqrt(sum(intensity * intensity) over (partition by measurement_id)), 6) as intensity
from profiles""",
        ),
    ),
    "normalize_max": (_normalize("max"), _normalize_sql("max(abs(intensity))")),
    "normalize_image": (normalize_image, NORMALIZE_IMAGE),
    "column_standardize": (column_standardize, COLUMN_STANDARDIZE),
    "norm_scale_by_type": (
        norm_scale_by_type,
        with_tables(
            "profiles",
            NORM_SCALE.format(by="type_measurement")
            + """select measurement_id, type_measurement, pos, round(norm, 8) as norm,
                        round(scaled, 6) + 0.0 as scaled from scaled""",
        ),
    ),
    "group_statistics": (
        group_statistics,
        with_tables(
            "profiles",
            """select label, pos, round(avg(intensity), 6) as mean,
                      round(stddev_pop(intensity), 6) as std from profiles group by 1, 2""",
        ),
    ),
    "group_mean_profile": (
        group_mean_profile,
        with_tables(
            "profiles",
            """select type_measurement, cancer_diagnosis, pos, round(avg(q), 6) as q,
                      round(avg(intensity), 6) as mean from profiles group by 1, 2, 3""",
        ),
    ),
    "model_matrix": (model_matrix, MODEL_MATRIX),
    "collect_cells": (collect_cells, COLLECT_CELLS),
}
