"""Registered queries over detector images, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import tidy
from ..operators import calibration, deviation, image, integrate
from ..sources import adapters
from ..sources.adapters import N_COLS, N_ROWS
from .oracle import NUDGE, with_tables

ID = "measurement_id"
NPT, AZIM = 24, 36
FAULTY = [(0, 0), (1, 1), (7, 12), (15, 15), (16, 15), (31, 4)]
ANGLES = [(-90, 0), (0, 90), (150, -150), (-180, 180)]
SAXS_RANGE = (0.08, 0.6)


def geo(spark: SparkSession, d: str) -> DataFrame:
    return integrate.default_geometry(
        adapters.pixels(spark, d), adapters.calibrations(spark, d), N_ROWS, N_COLS
    )


def _profile(df: DataFrame) -> DataFrame:
    return df.select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        F.col("n_pixels").cast("long").alias("n_pixels"),
        *[tidy(c).alias(c) for c in ("q", "intensity", "std", "sem")],
    )


BINNED = f"""
, binned as (
    select *, least(floor((q - q_lo) / (q_hi - q_lo) * {NPT}), {NPT - 1})::bigint as pos
    from geo where q between q_lo and q_hi)
"""

PROFILE = """
select measurement_id, pos, count(*) as n_pixels,
       round(max({lo}) + (pos + 0.5) * (max({hi}) - max({lo})) / {npt}, 6) as q,
       round(avg(value), 6) as intensity, round(stddev_pop(value), 6) as std,
       round(stddev_pop(value) / sqrt(count(*)), 6) as sem
from {source} group by measurement_id, pos
"""


def _profile_sql(source: str, lo: str = "q_lo", hi: str = "q_hi") -> str:
    return PROFILE.format(source=source, lo=lo, hi=hi, npt=NPT)


def integrate_1d(spark, d):
    df = integrate.integrate_1d(geo(spark, d), NPT)
    extra = ["calculated_distance", "center_x", "center_y"]
    return df.select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        F.col("n_pixels").cast("long").alias("n_pixels"),
        *[tidy(c).alias(c) for c in ("q", "intensity", "std", "sem", *extra)],
    )


INTEGRATE_1D = with_tables(
    "geo",
    BINNED
    + f"""
select measurement_id, pos, count(*) as n_pixels,
       round(max(q_lo) + (pos + 0.5) * (max(q_hi) - max(q_lo)) / {NPT}, 6) as q,
       round(avg(value), 6) as intensity, round(stddev_pop(value), 6) as std,
       round(stddev_pop(value) / sqrt(count(*)), 6) as sem,
       round(max(distance_m), 6) as calculated_distance,
       round(max(poni2 / pixel2), 6) as center_x, round(max(poni1 / pixel1), 6) as center_y
from binned group by measurement_id, pos""",
)


def integrate_solid_angle(spark, d):
    df = integrate.integrate_1d(geo(spark, d), NPT, correct_solid_angle=True)
    return df.select(
        ID, F.col("pos").cast("long").alias("pos"), tidy("intensity").alias("intensity")
    )


INTEGRATE_SOLID_ANGLE = with_tables(
    "geo",
    BINNED
    + """
select measurement_id, pos,
       round(sum(value) / sum(cos(atan2(sqrt(
           ((col_idx + 0.5::double) * pixel2 - poni2) ** 2
           + ((row_idx + 0.5::double) * pixel1 - poni1) ** 2), distance_m)) ** 3), 6) as intensity
from binned group by measurement_id, pos""",
)


def range_filters(spark, d):
    df = integrate.integrate_1d(
        geo(spark, d), NPT, q_range=SAXS_RANGE, chi_range=(-100.0, 75.0)
    )
    return _profile(df)


RANGE_FILTERS = with_tables(
    "geo",
    f"""
, picked as (
    select *, {SAXS_RANGE[0]}::double as lo, {SAXS_RANGE[1]}::double as hi,
           least(floor((q - {SAXS_RANGE[0]}::double)
                 / ({SAXS_RANGE[1]}::double - {SAXS_RANGE[0]}::double) * {NPT}), {NPT - 1})::bigint as pos
    from geo where q >= {SAXS_RANGE[0]} and q <= {SAXS_RANGE[1]} and chi >= -100 and chi <= 75)
"""
    + _profile_sql("picked", "lo", "hi"),
)


def pixel_mask(spark, d):
    masked = integrate.mask_pixels(adapters.pixels(spark, d), FAULTY)
    rows = integrate.default_geometry(
        masked, adapters.calibrations(spark, d), N_ROWS, N_COLS
    )
    return _profile(integrate.integrate_1d(rows, NPT))


PIXEL_MASK = with_tables(
    "geo",
    f"""
, good as (
    select *, least(floor((q - q_lo) / (q_hi - q_lo) * {NPT}), {NPT - 1})::bigint as pos
    from geo where (row_idx, col_idx) not in ({", ".join(str(p) for p in FAULTY)}))
"""
    + _profile_sql("good"),
)


def pixel_q(spark, d):
    return geo(spark, d).select(
        ID, "row_idx", "col_idx", tidy("q").alias("q"), tidy("chi").alias("chi")
    )


PIXEL_Q = with_tables(
    "geo",
    "select measurement_id, row_idx, col_idx, round(q, 6) as q, round(chi, 6) as chi from geo",
)


def pixel_q_from_columns(spark, d):
    """Geometry from pixel size, center, distance and wavelength columns."""
    columns = (
        calibration.with_center(adapters.calibrations(spark, d))
        .select(
            "cal_id",
            (F.col("pixel1") * 1e6).alias("pixel_size"),
            F.struct(
                F.col("center_y").alias("row"), F.col("center_x").alias("col")
            ).alias("center"),
            F.col("distance_m").alias("calculated_distance"),
            F.col("wavelength_nm").alias("wavelength"),
        )
    )
    rows = calibration.attach_calibration(
        adapters.pixels(spark, d), calibration.from_columns(columns)
    )
    return calibration.with_geometry(rows).select(
        ID, "row_idx", "col_idx", tidy("q").alias("q"), tidy("chi").alias("chi")
    )


def pixel_q_from_text(spark, d):
    """Geometry from the calibration text, parsed once per calibration."""
    parsed = calibration.parse_text(
        adapters.calibrations(spark, d).select("cal_id", "ponifile")
    )
    rows = calibration.attach_calibration(adapters.pixels(spark, d), parsed)
    return calibration.with_geometry(rows).select(
        ID, "row_idx", "col_idx", tidy("q").alias("q"), tidy("chi").alias("chi")
    )


def _tilted(spark, d):
    """Pixels with the geometry of calibration texts whose detectors are turned."""
    turns = {"Rot1": "(cal_id % 5 - 2) * 0.01D", "Rot2": "(cal_id % 7 - 3) * 0.02D", "Rot3": "(cal_id % 3) * 0.3D"}
    text = F.concat(
        "ponifile", *[F.concat(F.lit(f"\n{k}: "), F.format_string("%.4f", F.expr(v))) for k, v in turns.items()]
    )
    parsed = calibration.parse_text(
        adapters.calibrations(spark, d).select("cal_id", text.alias("ponifile"))
    )
    rows = calibration.attach_calibration(adapters.pixels(spark, d), parsed)
    return calibration.with_geometry(rows)


def pixel_q_tilted(spark, d):
    return _tilted(spark, d).select(
        ID, "row_idx", "col_idx", tidy("q").alias("q"), tidy("chi").alias("chi")
    )


# The turned coordinates as one matrix product.
TILTED = """
, placed as (
    select measurement_id, row_idx, col_idx, value, wavelength_nm, distance_m as l,
           (row_idx + 0.5::double) * pixel1 - poni1 as p1, (col_idx + 0.5::double) * pixel2 - poni2 as p2,
           (cal_id % 5 - 2) * 0.01::double as a, (cal_id % 7 - 3) * 0.02::double as b, (cal_id % 3) * 0.3::double as c
    from pixels join calibrations using (cal_id))
, turned as (
    select *,
           p1*cos(b)*cos(c) + p2*(cos(c)*sin(a)*sin(b) - cos(a)*sin(c)) - l*(cos(a)*cos(c)*sin(b) + sin(a)*sin(c)) as t1,
           p1*cos(b)*sin(c) + p2*(cos(a)*cos(c) + sin(a)*sin(b)*sin(c)) - l*(cos(a)*sin(b)*sin(c) - cos(c)*sin(a)) as t2,
           p1*sin(b) - p2*cos(b)*sin(a) + l*cos(a)*cos(b) as t3
    from placed)
, tilted as (
    select measurement_id, row_idx, col_idx, value,
           4 * pi() / wavelength_nm * sin(atan2(sqrt(t1 * t1 + t2 * t2), t3) / 2) as q, degrees(atan2(t1, t2)) as chi,
           -- the direction to the pixel and the detector's normal, both turned
           ((t1 * n1 + t2 * n2 + t3 * n3) / sqrt(t1 * t1 + t2 * t2 + t3 * t3)) ** 3 as solid
    from (select *, -(cos(a)*cos(c)*sin(b) + sin(a)*sin(c)) as n1, -(cos(a)*sin(b)*sin(c) - cos(c)*sin(a)) as n2,
                 cos(a)*cos(b) as n3 from turned))
"""

PIXEL_Q_TILTED = with_tables(
    "pixels calibrations",
    TILTED
    + """select measurement_id, row_idx, col_idx, round(q, 6) as q, round(chi, 6) as chi from tilted""",
)


def solid_angle_tilted(spark, d):
    df = integrate.integrate_1d(_tilted(spark, d), NPT, SAXS_RANGE, correct_solid_angle=True)
    return df.select(ID, F.col("pos").cast("long").alias("pos"), tidy("intensity").alias("intensity"))


def solid_angle_cake(spark, d):
    df = integrate.integrate_2d(_tilted(spark, d), NPT, AZIM, SAXS_RANGE, correct_solid_angle=True)
    return df.select(
        ID, F.col("chi_bin").cast("long").alias("chi_bin"), F.col("pos").cast("long").alias("pos"),
        tidy("intensity").alias("intensity"),
    )


def solid_angle_sector(spark, d):
    df = integrate.rotating_angles(_tilted(spark, d), [(-45, 60)], NPT, SAXS_RANGE, correct_solid_angle=True)
    return df.select(ID, F.col("pos").cast("long").alias("pos"), tidy("intensity").alias("intensity"))


SOLID = f"""
, solid as (
    select *, least(floor((q - {SAXS_RANGE[0]}::double) / ({SAXS_RANGE[1]}::double - {SAXS_RANGE[0]}::double) * {NPT}), {NPT - 1})::bigint as pos,
           least(floor((chi + 180) / 360.0::double * {AZIM}), {AZIM - 1})::bigint as chi_bin
    from tilted where q >= {SAXS_RANGE[0]} and q <= {SAXS_RANGE[1]})
"""


def _cake(spark, d):
    return integrate.integrate_2d(geo(spark, d), NPT, AZIM)


def integrate_2d(spark, d):
    return _cake(spark, d).select(
        ID,
        F.col("chi_bin").cast("long").alias("chi_bin"),
        F.col("pos").cast("long").alias("pos"),
        tidy("q").alias("q"),
        tidy("chi").alias("chi"),
        tidy("intensity").alias("intensity"),
    )


CAKE = (
    BINNED
    + f"""
, binned2 as (
    select *, least(floor((chi + 180.0) / 360.0 * {AZIM}), {AZIM - 1})::bigint as chi_bin
    from binned)
, cake as (
    select measurement_id, chi_bin, pos, avg(value) as intensity,
           max(q_lo) + (pos + 0.5) * (max(q_hi) - max(q_lo)) / {NPT} as q
    from binned2 group by measurement_id, chi_bin, pos)
"""
)

INTEGRATE_2D = with_tables(
    "geo",
    CAKE
    + f"""
select measurement_id, chi_bin, pos, round(q, 6) as q,
       round(-180.0::double + (chi_bin + 0.5::double) * (360.0::double / {AZIM}), 6) as chi,
       round(intensity, 6) as intensity
from cake""",
)


def cake_stats(spark, d):
    stats = integrate.cake_stats(_cake(spark, d))
    return stats.select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        *[
            tidy(F.col(c) + NUDGE).alias(c)
            for c in stats.columns
            if c.startswith("cake_")
        ],
    )


CAKE_STATS = with_tables(
    "geo",
    CAKE
    + f"""
, m as (
    select measurement_id, pos, avg(intensity) as mu, var_pop(intensity) as var
    from cake where intensity <> 0 group by all)
select measurement_id, pos, round(mu + {NUDGE}, 6) as cake_col_mean,
       round(var + {NUDGE}, 6) as cake_col_variance, round(sqrt(var) + {NUDGE}, 6) as cake_col_std,
       round(case when var > 1e-12 * mu * mu then m3 / var ** 1.5 end + {NUDGE}, 6) as cake_col_skew,
       round(case when var > 1e-12 * mu * mu then m4 / var ** 2 - 3 end + {NUDGE}, 6)
           as cake_col_kurtosis
from (
    select measurement_id, pos, any_value(mu) as mu, any_value(var) as var,
           avg((intensity - mu) ** 3) as m3, avg((intensity - mu) ** 4) as m4
    from cake join m using (measurement_id, pos) where intensity <> 0 group by measurement_id, pos)""",
)


def sigma_clip(spark, d):
    return _profile(
        integrate.sigma_clip(geo(spark, d), NPT, thres=1.5, max_iter=5)
    )


def _sigma_clip_sql(thres: float, rounds: int) -> str:
    parts = [BINNED, ", r0 as (select * from binned)"]
    for i in range(rounds):
        parts.append(
            f"""
, s{i} as (select measurement_id, pos, avg(value) as mu, stddev_pop(value) as sd
           from r{i} group by all)
, r{i + 1} as (select r{i}.* from r{i} join s{i} using (measurement_id, pos)
           where abs(value - mu) <= {thres} * sd + 1e-12 * abs(mu))"""
        )
    return with_tables("geo", "".join(parts) + _profile_sql(f"r{rounds}"))


def angular_ranges(spark, d):
    ranges = adapters.table(spark, d, "orders").select(
        F.col("o_orderkey").alias(ID),
        F.expr("cast(o_orderkey * 37 % 360 - 180 as double)").alias("range_start"),
        F.expr("cast(o_custkey * 53 % 361 - 180 as double)").alias("range_end"),
    )
    return integrate.split_ranges(ranges).select(
        ID,
        "range_start",
        "range_end",
        F.col("part").cast("long").alias("part"),
        "lo",
        "hi",
        tidy("weight").alias("weight"),
    )


ANGULAR_RANGES = """
with base as (
    select o_orderkey as measurement_id, (o_orderkey * 37 % 360 - 180)::double as s,
           (o_custkey * 53 % 361 - 180)::double as e from orders)
, norm as (
    select *, case when s = 180 then -180 else s end as a,
           case when e = 180 then -180 else e end as b,
           case when e >= s then e - s else 360 + e - s end as whole from base)
, parts as (
    select *, 0 as part, case when a >= b then -180 else a end as lo, b as hi from norm
    union all
    select *, 1 as part, a as lo, 180 as hi from norm where a >= b)
select measurement_id, s as range_start, e as range_end, part::bigint as part,
       lo::double as lo, hi::double as hi,
       case when whole = 0 then null else round((hi - lo)::double / whole, 6) end as weight
from parts"""


def _rotating(spark, d):
    return integrate.rotating_angles(geo(spark, d), ANGLES, NPT)


def rotating_angles(spark, d):
    return _rotating(spark, d).select(
        ID,
        F.col("range_no").cast("long").alias("range_no"),
        "range_start",
        "range_end",
        F.col("pos").cast("long").alias("pos"),
        *[tidy(c).alias(c) for c in ("q", "intensity", "sigma", "std")],
    )


ROTATING = (
    BINNED
    + """
, parts(range_no, range_start, range_end, lo, hi, w) as (values
    (0, -90, 0, -90, 0, 1.0), (1, 0, 90, 0, 90, 1.0),
    (2, 150, -150, -180, -150, 0.5), (2, 150, -150, 150, 180, 0.5),
    (3, -180, 180, -180, -180, 0.0), (3, -180, 180, -180, 180, 1.0))
, per_part as (
    select measurement_id, range_no, range_start, range_end, lo, pos,
           any_value(w)::double as w, avg(value) as mu, stddev_pop(value) as sd,
           stddev_pop(value) / sqrt(count(*)) as se,
           max(q_lo) + (pos + 0.5) * (max(q_hi) - max(q_lo)) / %d as q
    from binned join parts on chi >= lo and chi <= hi
    group by measurement_id, range_no, range_start, range_end, lo, hi, pos)
, rotated as (
    select measurement_id, range_no::bigint as range_no, range_start::double as range_start,
           range_end::double as range_end, pos, round(max(q), 6) as q,
           round(sum(w * mu), 6) as intensity, round(sqrt(sum((w * se) ** 2)), 6) as sigma,
           round(sqrt(sum((w * sd) ** 2)), 6) as std
    from per_part group by all)
"""
    % NPT
)


def rotating_angles_wide(spark, d):
    wide = integrate.rotating_angles_wide(_rotating(spark, d), ANGLES)
    return wide.select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        *[
            tidy(F.col(f"`{c}`")).alias(c)
            for c in wide.columns
            if c not in {ID, "pos"}
        ],
    )


def _rotating_wide_sql() -> str:
    columns = ",\n".join(
        f'max(case when range_no = {i} then {source} end) as "{name}_{a}_{b}"'
        for i, (a, b) in enumerate(ANGLES)
        for source, name in (
            ("q", "q_range"),
            ("intensity", "radial_profile_data"),
            ("sigma", "sigma"),
            ("std", "std"),
        )
    )
    return with_tables(
        "geo",
        ROTATING
        + f"select measurement_id, pos, {columns} from rotated group by measurement_id, pos",
    )


def deviation_rings(spark, d):
    long = deviation.deviation(geo(spark, d), [1.2, 1.5], [0.8], NPT)
    return long.select(
        ID,
        F.col("digit").cast("long").alias("digit"),
        "side",
        "limit",
        tidy("deviation").alias("deviation"),
    )


RINGS = f"""
, centers as (
    select cal_id, q_lo + (i + 0.5::double) * (q_hi - q_lo) / {NPT} as edge
    from q_limits, range(0, {NPT}) t(i))
, digits as (
    select g.*, (select count(*) from centers c where c.cal_id = g.cal_id and c.edge <= g.q) as digit
    from geo g)
, rings as (
    select *, avg(value) over (partition by measurement_id, digit) as mu from digits)
"""

DEVIATION = with_tables(
    "geo",
    RINGS
    + """
, flags as (
    select measurement_id, digit, 'above' as side, 1.2::double as "limit",
           case when value > mu * 1.2::double + 1e-12 * abs(mu) then value end as v from rings
    union all
    select measurement_id, digit, 'above', 1.5, case when value > mu * 1.5::double + 1e-12 * abs(mu) then value end from rings
    union all
    select measurement_id, digit, 'below', 0.8,
           case when value < mu * 0.8::double - 1e-12 * abs(mu) and value <> 0 then value end from rings)
select measurement_id, digit, side, "limit", round(avg(v), 6) as deviation
from flags group by all""",
)


def deviation_images(spark, d):
    return deviation.deviation_images(geo(spark, d), [1.2, 1.5], [0.8], NPT)


DEVIATION_IMAGES = with_tables(
    "geo",
    RINGS
    + """
select measurement_id, row_idx, col_idx,
       case when value > mu * 1.2::double + 1e-12 * abs(mu) then value else 0 end as "image_above_1.2",
       case when value > mu * 1.5::double + 1e-12 * abs(mu) then value else 0 end as "image_above_1.5",
       case when value < mu * 0.8::double - 1e-12 * abs(mu) and value <> 0 then value else 0 end as "image_below_0.8"
from rings""",
)


def deviation_cake(spark, d):
    long = deviation.cake_deviation(_cake(spark, d), AZIM, [1.2], [0.8])
    return long.select(
        ID,
        F.col("pos").cast("long").alias("pos"),
        "side",
        "limit",
        tidy(F.col("deviation") + NUDGE).alias("deviation"),
    )


DENSE_CAKE = (
    CAKE
    + f"""
, dense as (
    select m.measurement_id, b.chi_bin, m.pos, coalesce(c.intensity, 0) as v,
           avg(nullif(c.intensity, 0)) over (partition by m.measurement_id, m.pos) as mu
    from (select distinct measurement_id, pos from cake) m
    cross join range(0, {AZIM}) b(chi_bin)
    left join cake c on c.measurement_id = m.measurement_id and c.pos = m.pos
         and c.chi_bin = b.chi_bin)
"""
)

DEVIATION_CAKE = with_tables(
    "geo",
    DENSE_CAKE
    + f"""
, flagged as (
    select measurement_id, pos, 'above' as side, 1.2::double as "limit",
           case when v > mu * 1.2::double + 1e-12 * abs(mu) then v end as x from dense where mu is not null
    union all
    select measurement_id, pos, 'below', 0.8,
           case when v < mu * 0.8::double - 1e-12 * abs(mu) then v end from dense where mu is not null)
select measurement_id, pos, side, "limit", round(nullif(avg(x), 0) + {NUDGE}, 6) as deviation
from flagged group by all""",
)


def deviation_cake_images(spark, d):
    rows = integrate.with_chi_bin(integrate.with_q_bin(geo(spark, d), NPT), AZIM)
    flags = deviation.cake_flags(_cake(spark, d), [1.2], [0.8])
    back = deviation.project_back(rows, flags)
    return back.select(
        ID,
        "row_idx",
        "col_idx",
        *[tidy(F.col(f"`{c}`")).alias(c) for c in back.columns if "image" in c],
    )


DEVIATION_CAKE_IMAGES = with_tables(
    "geo",
    DENSE_CAKE
    + """
select p.measurement_id, p.row_idx, p.col_idx,
       round(case when v > mu * 1.2::double + 1e-12 * abs(mu) then v else 0 end, 6) as "image_above_1.2",
       round(case when v < mu * 0.8::double - 1e-12 * abs(mu) then v else 0 end, 6) as "image_below_0.8"
from binned2 p join dense using (measurement_id, chi_bin, pos)""",
)


def deviation_wide(spark, d):
    long = deviation.deviation(geo(spark, d), [1.2, 1.5], [0.8], NPT)
    wide = deviation.deviation_wide(long, "digit", [1.2, 1.5], [0.8])
    return wide.select(
        ID,
        F.col("digit").cast("long").alias("digit"),
        *[tidy(F.col(f"`{c}`")).alias(c) for c in wide.columns if "_" in c and c != ID],
    )


DEVIATION_WIDE = with_tables(
    "geo",
    RINGS
    + """
select measurement_id, digit,
       round(avg(case when value > mu * 1.2::double + 1e-12 * abs(mu) then value end), 6) as "deviation_above_1.2",
       round(avg(case when value > mu * 1.5::double + 1e-12 * abs(mu) then value end), 6) as "deviation_above_1.5",
       round(avg(case when value < mu * 0.8::double - 1e-12 * abs(mu) and value <> 0 then value end), 6)
           as "deviation_below_0.8"
from rings group by measurement_id, digit""",
)


def _calibrated(spark, d):
    return calibration.attach_calibration(
        adapters.pixels(spark, d), adapters.calibrations(spark, d)
    )


def ring_cut(spark, d):
    return image.ring_cut(_calibrated(spark, d), [(None, 4), (9.5, 12), (20, None)]).select(
        ID, "row_idx", "col_idx", "value"
    )


RING_CUT = with_tables(
    "pixels calibrations",
    """
, far as (
    select p.*, sqrt((col_idx - poni2 / pixel2) ** 2 + (row_idx - poni1 / pixel1) ** 2) as r
    from pixels p join calibrations using (cal_id))
select measurement_id, row_idx, col_idx,
       case when r <= 4 or (r >= 9.5 and r <= 12) or r >= 20 then 0 else value end as value
from far""",
)


def image_resize(spark, d):
    return image.image_resize(
        adapters.pixels(spark, d), adapters.calibrations(spark, d), 140.0, N_ROWS, N_COLS
    ).select(ID, "row_idx", "col_idx", "value")


IMAGE_RESIZE = with_tables(
    "pixels calibrations",
    """
, size as (
    select cal_id, floor(32 * (140.0::double * 0.001 / distance_m) + 1e-9)::int as n from calibrations)
, taps as (
    select cal_id, o, (o + 0.5::double) * (32::double / n) - 0.5 as loc, t
    from size, lateral (select unnest(range(0, n)) as o), (values (-1), (0), (1), (2)) k(t))
, placed as (
    select cal_id, o, greatest(0, least(31, floor(loc) + t))::int as i,
           abs(loc - (floor(loc) + t)) as x from taps)
, weights as (
    select cal_id, o, i, sum(case
        when x <= 1 then 1.25 * x ** 3 - 2.25 * x ** 2 + 1
        when x < 2 then -0.75 * x ** 3 + 3.75 * x ** 2 - 6 * x + 3 else 0 end) as w
    from placed group by all)
select measurement_id, a.o::int as row_idx, b.o::int as col_idx,
       greatest(0::double, least(65535::double,
           round_even(round(sum(value * a.w * b.w), 9), 0))) as value
from pixels p join weights a on a.cal_id = p.cal_id and a.i = p.row_idx
     join weights b on b.cal_id = p.cal_id and b.i = p.col_idx
group by measurement_id, a.o, b.o""",
)


def _exposures(spark, d):
    return calibration.attach_calibration(
        adapters.measurements(spark, d).filter("cal_id is not null"),
        adapters.calibrations(spark, d),
    )


def common_region(spark, d):
    return image.common_region(_exposures(spark, d), N_ROWS, N_COLS).select(
        F.lit(False).alias("square"), "*"
    ).unionByName(
        image.common_region(_exposures(spark, d), N_ROWS, N_COLS, square=True).select(
            F.lit(True).alias("square"), "*"
        )
    )


REGION = """
, ends as (
    select min(poni2 / pixel2) as u, min(32 - poni2 / pixel2) as d,
           min(poni1 / pixel1) as l, min(32 - poni1 / pixel1) as r
    from measurements join calibrations using (cal_id))
, region as (
    select false as square, floor(u) as max_up, floor(d) as max_down, floor(l) as max_left,
           floor(r) as max_right from ends
    union all
    select true,
           floor(case when u + d < l + r then u else u / (u + d) * (l + r) end),
           floor(case when u + d < l + r then d else d / (u + d) * (l + r) end),
           floor(case when u + d < l + r then l / (l + r) * (u + d) else l end),
           floor(case when u + d < l + r then r / (l + r) * (u + d) else r end) from ends)
"""

COMMON_REGION = with_tables(
    "measurements calibrations", REGION + "select * from region"
)


def common_crop(spark, d):
    region = image.common_region(_exposures(spark, d), N_ROWS, N_COLS, square=True)
    return image.common_crop(_calibrated(spark, d), region).select(
        ID,
        "row_idx",
        "col_idx",
        "value",
        tidy("poni1").alias("poni1"),
        tidy("poni2").alias("poni2"),
    )


COMMON_CROP = with_tables(
    "pixels calibrations measurements",
    REGION
    + """
, placed as (
    select p.*, c.pixel1, c.pixel2, g.max_up, g.max_left,
           trunc(poni2 / pixel2 - max_up)::int as x0, trunc(poni2 / pixel2 + max_down)::int as x1,
           trunc(poni1 / pixel1 - max_left)::int as y0, trunc(poni1 / pixel1 + max_right)::int as y1
    from pixels p join calibrations c using (cal_id), (select * from region where square) g)
select measurement_id, row_idx - y0 as row_idx, col_idx - x0 as col_idx, value,
       round(max_left * pixel1, 6) as poni1, round(max_up * pixel2, 6) as poni2
from placed where row_idx >= y0 and row_idx < y1 and col_idx >= x0 and col_idx < x1""",
)


def beam_center(spark, d):
    return image.beam_center(adapters.pixels(spark, d), 1.6).select(
        ID,
        tidy("center_row").alias("center_row"),
        tidy("center_col").alias("center_col"),
        F.col("area").cast("long").alias("area"),
    )


# Bright pixels and the first pixel of the region of each.
REGIONS = """
, lit as (
    select measurement_id as m, row_idx as r, col_idx as c, row_idx * 32 + col_idx as n
    from (select *, avg(value) over (partition by measurement_id) as mu from pixels)
    where value > 1.6 * mu)
, near as (
    select a.m, a.n as a, b.n as b from lit a join lit b
    on a.m = b.m and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1)
, reach(m, a, b) as (
    select m, n, n from lit
    union
    select reach.m, reach.a, near.b from reach join near on reach.m = near.m and reach.b = near.a)
, labels as (select m, a, min(b) as label from reach group by m, a)
"""

BEAM_CENTER = (
    "with recursive "
    + with_tables(
        "pixels",
        REGIONS
        + """
, regions as (
    select labels.m, label, count(*) as area, avg(r) as cr, avg(c) as cc
    from labels join lit on labels.m = lit.m and labels.a = lit.n group by labels.m, label)
, top as (
    select *, row_number() over (partition by m order by area desc, label) as rn from regions)
select p.measurement_id, round(cr, 6) as center_row, round(cc, 6) as center_col, area
from (select distinct measurement_id from pixels) p
     left join top on top.m = p.measurement_id and rn = 1""",
    ).removeprefix("with ")
)


def beam_box(spark, d):
    return image.beam_box(adapters.pixels(spark, d), 140.0, 2, N_ROWS, N_COLS).select(
        ID, "row_idx", "col_idx", "value", "beam"
    )


BEAM_BOX = with_tables(
    "pixels",
    """
, box as (
    select measurement_id, min(row_idx) - 2 as r0, max(row_idx) + 2 as r1,
           min(col_idx) - 2 as c0, max(col_idx) + 2 as c1
    from pixels where value > 140 group by 1)
select measurement_id, row_idx, col_idx, value,
       case when row_idx between r0 and r1 and col_idx between c0 and c1 then value else 0 end as beam
from pixels left join box using (measurement_id)""",
)


def mask_product(spark, d):
    mask = adapters.pixels(spark, d).groupBy("row_idx", "col_idx").agg(
        F.when(F.sum("value") % 3 == 0, 0.0).otherwise(1.0).alias("m")
    )
    return image.mask_product(adapters.pixels(spark, d), mask).select(
        ID, "row_idx", "col_idx", "value"
    )


MASK_PRODUCT = with_tables(
    "pixels",
    """
, mask as (
    select row_idx, col_idx, case when sum(value) % 3 = 0 then 0.0 else 1.0 end as m
    from pixels group by 1, 2)
select measurement_id, row_idx, col_idx, value * m::double as value
from pixels join mask using (row_idx, col_idx)""",
)

QUERIES = {
    "integrate_1d": (integrate_1d, INTEGRATE_1D),
    "integrate_solid_angle": (integrate_solid_angle, INTEGRATE_SOLID_ANGLE),
    "range_filters": (range_filters, RANGE_FILTERS),
    "pixel_mask": (pixel_mask, PIXEL_MASK),
    "pixel_q": (pixel_q, PIXEL_Q),
    "pixel_q_from_columns": (pixel_q_from_columns, PIXEL_Q),
    "pixel_q_from_text": (pixel_q_from_text, PIXEL_Q),
    "pixel_q_tilted": (pixel_q_tilted, PIXEL_Q_TILTED),
    "solid_angle_tilted": (
        solid_angle_tilted,
        with_tables(
            "pixels calibrations",
            TILTED + SOLID + "select measurement_id, pos, round(sum(value) / sum(solid), 6) as intensity from solid group by 1, 2",
        ),
    ),
    "solid_angle_cake": (
        solid_angle_cake,
        with_tables(
            "pixels calibrations",
            TILTED + SOLID + """select measurement_id, chi_bin, pos, round(sum(value) / sum(solid), 6) as intensity
            from solid group by 1, 2, 3""",
        ),
    ),
    "solid_angle_sector": (
        solid_angle_sector,
        with_tables(
            "pixels calibrations",
            TILTED + SOLID + """select measurement_id, pos, round(sum(value) / sum(solid), 6) as intensity
            from solid where chi between -45 and 60 group by 1, 2""",
        ),
    ),
    "integrate_2d": (integrate_2d, INTEGRATE_2D),
    "cake_stats": (cake_stats, CAKE_STATS),
    "sigma_clip": (sigma_clip, _sigma_clip_sql(1.5, 5)),
    "angular_ranges": (angular_ranges, ANGULAR_RANGES),
    "rotating_angles": (
        rotating_angles,
        with_tables("geo", ROTATING + "select * from rotated"),
    ),
    "rotating_angles_wide": (rotating_angles_wide, _rotating_wide_sql()),
    "deviation": (deviation_rings, DEVIATION),
    "deviation_images": (deviation_images, DEVIATION_IMAGES),
    "deviation_wide": (deviation_wide, DEVIATION_WIDE),
    "deviation_cake": (deviation_cake, DEVIATION_CAKE),
    "deviation_cake_images": (deviation_cake_images, DEVIATION_CAKE_IMAGES),
    "ring_cut": (ring_cut, RING_CUT),
    "image_resize": (image_resize, IMAGE_RESIZE),
    "common_region": (common_region, COMMON_REGION),
    "common_crop": (common_crop, COMMON_CROP),
    "beam_center": (beam_center, BEAM_CENTER),
    "beam_box": (beam_box, BEAM_BOX),
    "mask_product": (mask_product, MASK_PRODUCT),
}
