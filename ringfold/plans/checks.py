"""Registered queries of the measurement checks, each with its checking SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import tidy
from ..functions.layout import collect_image
from ..operators import detector_checks, integrate, pattern_checks, signal_checks
from ..sources import adapters
from ..sources.adapters import N_COLS, N_ROWS
from .images import ID, NPT, PROFILE, REGIONS, _profile, geo
from .oracle import NUDGE, with_tables

# The derived images are sparse: a position is compared at a high level.
PERIOD, LEVEL, DEAD, HOT = 10, 0.9, 0.45, 1.6
SHARE = 0.6
FACTOR, LEAST, MAX_RUN = 4.0, 12.0, 2
ORDER = 2
PROMINENCE, WINDOW = 0.2, 0.05
SLACK, LIMIT, BLOCK = 0.5, 2.0, 16


def _persistence(spark, d):
    return detector_checks.pixel_persistence(
        adapters.pixels(spark, d), F.expr(f"{ID} div {PERIOD}"), N_ROWS, N_COLS, DEAD, HOT, LEVEL
    )


def pixel_persistence(spark, d):
    return _persistence(spark, d).select(
        "row_idx", "col_idx", "n_periods", "n_dead", "n_hot", tidy("ratio").alias("ratio")
    )


def _broken(spark, d):
    # the smallest tables have a single period
    return detector_checks.broken_pixels(_persistence(spark, d), SHARE, min_periods=1)


def broken_pixels(spark, d):
    return _broken(spark, d).select("row_idx", "col_idx", "kind", "n_periods", "n_dead", "n_hot")


def integrate_unbroken(spark, d):
    left = detector_checks.without_positions(adapters.pixels(spark, d), _broken(spark, d))
    rows = integrate.default_geometry(left, adapters.calibrations(spark, d), N_ROWS, N_COLS)
    return _profile(integrate.integrate_1d(rows, NPT))


GROWTH, NOTHING = detector_checks.GROWTH, detector_checks.NOTHING
LOG = math.log(GROWTH)
PERSISTENCE = f"""
, relative as (
    select row_idx, col_idx, measurement_id // {PERIOD} as period, measurement_id,
           value / avg(value) over (partition by measurement_id) as v from pixels)
, lit as (
    select row_idx, col_idx, period,
           case when v > 0 then ceil(ln(v) / {LOG!r}::double)::int else {NOTHING} end as bucket,
           count(*) as n
    from relative group by all)
, images as (
    select measurement_id // {PERIOD} as period, count(distinct measurement_id) as images from pixels group by 1)
, sketch as (
    select * from lit
    union all
    select r, c, period, {NOTHING}, images - coalesce(seen, 0)
    from images, range(0, {N_ROWS}) a(r), range(0, {N_COLS}) b(c)
    left join (select row_idx, col_idx, period as p, sum(n) as seen from lit group by all) s
    on s.row_idx = r and s.col_idx = c and s.p = period where images > coalesce(seen, 0))
, own as (
    select row_idx, col_idx, period, min(bucket) as bucket from (
        select *, sum(n) over (partition by row_idx, col_idx, period order by bucket) as upto,
               sum(n) over (partition by row_idx, col_idx, period) as every from (
            select row_idx, col_idx, period, bucket, sum(n) as n from sketch group by all))
    where upto >= greatest(ceil(every * {LEVEL}::double), 1) group by all)
, every as (
    select period, min(bucket) as bucket from (
        select *, sum(n) over (partition by period order by bucket) as upto,
               sum(n) over (partition by period) as every from (
            select period, bucket, sum(n) as n from sketch group by all))
    where upto >= greatest(ceil(every * {LEVEL}::double), 1) group by all)
, ratios as (
    select row_idx, col_idx,
           case when own.bucket = {NOTHING} then 0
                else {GROWTH}::double ** own.bucket / {GROWTH}::double ** every.bucket end as ratio
    from own join every using (period) where every.bucket <> {NOTHING})
, persistence as (
    select row_idx, col_idx, count(*) as n_periods, count_if(ratio <= {DEAD}) as n_dead,
           count_if(ratio >= {HOT}) as n_hot, round(avg(ratio), 6) as ratio
    from ratios group by all)
, broken as (
    select row_idx, col_idx, case when n_dead >= {SHARE} * n_periods then 'dead' else 'hot' end as kind,
           n_periods, n_dead, n_hot
    from persistence
    where (n_dead >= {SHARE} * n_periods or n_hot >= {SHARE} * n_periods))
"""
UNBROKEN = f"""
, binned as (
    select *, least(floor((q - q_lo) / (q_hi - q_lo) * {NPT}), {NPT - 1})::bigint as pos
    from geo anti join broken using (row_idx, col_idx) where q between q_lo and q_hi)
"""


def _dense(spark, d):
    return collect_image(adapters.pixels(spark, d), [ID], N_ROWS, N_COLS)


def _rays(spark, d):
    return detector_checks.cosmic_rays(_dense(spark, d), FACTOR, LEAST, MAX_RUN)


def cosmic_rays(spark, d):
    return _rays(spark, d).select(ID, F.explode("rays").alias("r")).select(ID, "r.*")


def rays_removed(spark, d):
    clean = detector_checks.without_rays(_rays(spark, d))
    lines = clean.select(ID, F.posexplode("measurement_data").alias("row_idx", "line"))
    return lines.select(ID, "row_idx", F.posexplode("line").alias("col_idx", "value"))


def _islands(line: str, at: str) -> str:
    return f"""select measurement_id, r, c, count(*) over (partition by measurement_id, line, island) as run from (
        select *, {at} - row_number() over (partition by measurement_id, {line} order by {at}) as island,
               {line} as line from spikes)"""


RAYS = f"""
, dense as (
    select m.measurement_id, r, c, coalesce(value, 0)::double as v
    from (select distinct measurement_id from pixels) m, range(0, {N_ROWS}) a(r), range(0, {N_COLS}) b(c)
    left join pixels p on p.measurement_id = m.measurement_id and p.row_idx = r and p.col_idx = c)
, near as (
    select a.measurement_id, a.r, a.c, a.v, b.v as w from dense a join dense b
    on a.measurement_id = b.measurement_id and b.r between a.r - 1 and a.r + 1
       and b.c between a.c - 1 and a.c + 1 and (a.r <> b.r or a.c <> b.c))
, middles as (select measurement_id, r, c, v, median(w) as mid from near group by all)
, spread as (
    select n.measurement_id, n.r, n.c, n.v, mid, median(abs(w - mid)) as mad
    from near n join middles m using (measurement_id, r, c) group by all)
, spikes as (
    select * from spread where v - mid > {FACTOR} * greatest({detector_checks.ROBUST} * mad, {LEAST}))
, runs as (
    select measurement_id, r, c, max(run) as run from (
        {_islands("r", "c")} union all {_islands("c", "r")}
        union all {_islands("r - c", "r")} union all {_islands("r + c", "r")}) group by all)
, rays as (
    select measurement_id, r, c, v, mid, run from runs join spikes using (measurement_id, r, c)
    where run <= {MAX_RUN})
"""


def ring_harmonics(spark, d):
    rings = pattern_checks.ring_harmonics(geo(spark, d), NPT, ORDER)
    indices = [tidy(f"index_{k}").alias(f"index_{k}") for k in range(1, ORDER + 1)]
    return rings.select(
        ID, F.col("pos").cast("long").alias("pos"), "n_pixels", tidy("mean").alias("mean"), *indices
    )


def asymmetry(spark, d):
    rings = pattern_checks.ring_harmonics(geo(spark, d), NPT, ORDER)
    found = pattern_checks.asymmetry(rings, ORDER, min_pixels=8)
    return found.select(ID, "n_rings", *[tidy(f"index_{k}").alias(f"index_{k}") for k in range(1, ORDER + 1)])


def _harmonics_sql() -> str:
    """The normal equations with the products summed one by one, solved by
    elimination without exchange."""
    size = 2 * ORDER + 1
    basis = ["1.0::double"]
    for k in range(1, ORDER + 1):
        basis += [f"cos({k} * radians(chi))", f"sin({k} * radians(chi))"]
    columns = ", ".join(f"{b} as f{i}" for i, b in enumerate(basis))
    sums = [f"sum(f{i} * f{j}) as m0_{i}_{j}" for i in range(size) for j in range(size)]
    sums += [f"sum(f{i} * value) as m0_{i}_{size}" for i in range(size)]
    own = ", ".join(f"d{i}" for i in range(size))
    sums += [f"sum(f{i} * f{i}) as d{i}" for i in range(size)]
    text = f"""
, based as (
    select measurement_id, value, least(floor((q - q_lo) / (q_hi - q_lo) * {NPT}), {NPT - 1})::bigint as pos, {columns}
    from geo where q between q_lo and q_hi)
, e0 as (select measurement_id, pos, count(*) as n_pixels, true as told, {", ".join(sums)} from based group by measurement_id, pos)
"""
    for k in range(size):
        cells = [
            f"m{k}_{i}_{j} - m{k}_{i}_{k} / m{k}_{k}_{k} * m{k}_{k}_{j} as m{k + 1}_{i}_{j}" if i > k
            else f"m{k}_{i}_{j} as m{k + 1}_{i}_{j}"
            for i in range(size) for j in range(size + 1)
        ]
        text += f"""
, e{k + 1} as (
    select measurement_id, pos, n_pixels, {own}, told and coalesce(m{k}_{k}_{k} > 1e-3 * d{k}, false) as told, {", ".join(cells)}
    from e{k})
"""
    text += ", s" + str(size) + f" as (select * from e{size})\n"
    for i in reversed(range(size)):
        rest = "".join(f" - m{size}_{i}_{j} * a{j}" for j in range(i + 1, size))
        text += f", s{i} as (select *, case when told then (m{size}_{i}_{size}{rest}) / m{size}_{i}_{i} end as a{i} from s{i + 1})\n"
    indices = ", ".join(
        f"round(sqrt(a{2 * k - 1} ** 2 + a{2 * k} ** 2) / case when a0 > 0 then a0 end, 6) as index_{k}"
        for k in range(1, ORDER + 1)
    )
    return text + f", rings as (select measurement_id, pos, n_pixels, round(a0, 6) + 0.0 as mean, {indices} from s0)\n"


HARMONICS = _harmonics_sql()


def center_shape(spark, d):
    found = pattern_checks.center_shape(adapters.pixels(spark, d), 1.6)
    return found.select(
        ID, "area",
        *[tidy(c).alias(c) for c in ("center_row", "center_col", "major", "minor", "roundness", "angle", "fill")],
    )


CENTER_SHAPE = (
    "with recursive "
    + with_tables(
        "pixels",
        REGIONS
        + """
, moments as (
    select labels.m, label, count(*) as n, avg(r) as cr, avg(c) as cc,
           avg(r * r) - avg(r) ** 2 + 1.0::double / 12 as vr, avg(c * c) - avg(c) ** 2 + 1.0::double / 12 as vc,
           avg(r * c) - avg(r) * avg(c) as vrc
    from labels join lit on labels.m = lit.m and labels.a = lit.n group by labels.m, label)
, top as (
    select *, row_number() over (partition by m order by n desc, label) as rn from moments)
, axes as (
    select *, (vr + vc) / 2 as half, sqrt(((vc - vr) / 2) ** 2 + vrc ** 2) as reach from top where rn = 1)
select p.measurement_id, n as area, round(cr, 6) as center_row, round(cc, 6) as center_col,
       round(2 * sqrt(half + reach), 6) as major, round(2 * sqrt(half - reach), 6) as minor,
       round(sqrt((half - reach) / (half + reach)), 6) as roundness,
       round(case when reach <= 1e-9 then 0 else degrees(atan2(2 * vrc, vc - vr)) / 2 end, 6) + 0.0 as angle,
       round(n / (4 * pi() * sqrt(half + reach) * sqrt(half - reach)), 6) as fill
from (select distinct measurement_id from pixels) p left join axes on axes.m = p.measurement_id""",
    ).removeprefix("with ")
)


def _peaked_arrays(spark, d):
    cen = F.col("label") * 0.3 + 2.0
    bumped = F.transform(
        "radial_profile_data",
        lambda y, i: y + 2.0 * F.exp(-F.pow((i + 1) * F.lit(0.1) - cen, 2) / 0.5),
    )
    return adapters.profile_arrays(spark, d).withColumn("radial_profile_data", bumped)


def peaks(spark, d):
    found = signal_checks.peaks(_peaked_arrays(spark, d), PROMINENCE)
    return found.select(ID, F.explode("peaks").alias("p")).select(
        ID, F.col("p.pos").cast("long").alias("pos"),
        *[tidy(F.col(f"p.{c}")).alias(c) for c in ("place", "height", "prominence")],
    )


def peak_consistency(spark, d):
    found = signal_checks.peaks(_peaked_arrays(spark, d), PROMINENCE)
    told = signal_checks.peak_consistency(found, "label", WINDOW)
    return told.select(
        ID, "label", "reference_id", F.col("peak").cast("long").alias("peak"),
        *[tidy(c).alias(c) for c in ("q_reference", "q_found", "shift")], "consistent",
    )


PEAKS = f"""
, higher as (
    select a.measurement_id, a.pos, a.intensity as y,
           max(b.pos) filter (where b.pos < a.pos and b.intensity >= a.intensity) as l,
           min(b.pos) filter (where b.pos > a.pos and b.intensity > a.intensity) as r,
           max(b.intensity) - min(b.intensity) as span, min(b.intensity) as lowest,
           max(b.intensity) filter (where b.pos = a.pos - 1) as y0,
           max(b.intensity) filter (where b.pos = a.pos + 1) as y1,
           count(*) as n
    from peaked a join peaked b using (measurement_id) group by all)
, saddles as (
    select h.*, min(b.intensity) filter (where b.pos between l and h.pos) as sl,
           min(b.intensity) filter (where b.pos between h.pos and r) as sr
    from higher h join peaked b using (measurement_id) group by all)
, peaks as (
    select measurement_id, pos, y,
           y - coalesce(greatest(case when l is not null then sl end, case when r is not null then sr end), lowest) as prominence,
           pos + case when y0 - 2 * y + y1 < 0 and y >= y0 and y > y1 then (y0 - y1) / (2 * (y0 - 2 * y + y1)) else 0 end as place
    from saddles
    where pos > 0 and pos < n - 1 and y0 < y and y1 < y
      and y - coalesce(greatest(case when l is not null then sl end, case when r is not null then sr end), lowest) >= {PROMINENCE} * span)
"""
CONSISTENCY = f"""
, placed as (
    select p.measurement_id, label, pos, 0.1::double * (place + 1) as x
    from peaks p join (select distinct measurement_id, label from peaked) using (measurement_id))
, refs as (
    select label, min(measurement_id) as reference_id from placed group by 1)
, wanted as (
    select r.label, reference_id, row_number() over (partition by r.label order by pos) - 1 as peak, x as q_reference
    from refs r join placed p on p.measurement_id = reference_id)
, pairs as (
    select m.measurement_id, w.*, p.x as q_found, row_number() over (
        partition by m.measurement_id, peak order by abs(p.x - q_reference), p.x) as rn
    from (select distinct measurement_id, label from peaked) m join wanted w using (label)
    left join placed p on p.measurement_id = m.measurement_id and abs(p.x - q_reference) <= {WINDOW}::double * abs(q_reference))
select measurement_id, label, reference_id, peak, round(q_reference, 6) as q_reference, round(q_found, 6) as q_found,
       round((q_found - q_reference) / q_reference, 6) + 0.0 as shift,
       coalesce(abs((q_found - q_reference) / q_reference) <= {signal_checks.TOLERANCE}, false) as consistent
from pairs where rn = 1"""


def intensity_stability(spark, d):
    series = adapters.pixels(spark, d).groupBy("cal_id", ID).agg(F.sum("value").alias("intensity"))
    found = signal_checks.intensity_stability(series, ["cal_id"], SLACK, LIMIT, block=BLOCK)
    return found.select("cal_id", ID, *[tidy(c).alias(c) for c in ("z", "high", "low")], "stable")


STABILITY = f"""
, series as (
    select cal_id, measurement_id, sum(value) as v from pixels group by all)
, scored as (
    select *, case when stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w else 0 end as z
    from series window w as (partition by cal_id))
, summed as (
    select *, sum(z - {SLACK}) over w as up, sum(-z - {SLACK}) over w as down
    from scored window w as (partition by cal_id order by measurement_id))
, told as (
    select cal_id, measurement_id, z, up - least(0, min(up) over w) as high, down - least(0, min(down) over w) as low
    from summed window w as (partition by cal_id order by measurement_id))
select cal_id, measurement_id, round(z, 6) + 0.0 as z, round(high, 6) + 0.0 as high, round(low, 6) + 0.0 as low,
       high <= {LIMIT} and low <= {LIMIT} as stable
from told"""


QUALITY = ("level", "noise", "signal", "snr", "runs_z")


def signal_quality(spark, d):
    found = signal_checks.signal_quality(_peaked_arrays(spark, d))
    return found.select(ID, *[tidy(c).alias(c) for c in QUALITY])


def quality_verdict(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("tissue", "background", "empty", "dark", "other")]), (F.col(ID) % 5 + 1).cast("int"))
    found = signal_checks.signal_quality(adapters.profile_arrays(spark, d)).withColumn("kind", kind)
    return signal_checks.quality_verdict(found, F.col("kind"), 2.2, 1.01, 1.0).select(ID, "kind", "passed")


def _quality_sql(source: str) -> str:
    return f"""
, bends as (
    select measurement_id, median(abs(a - 2 * b + c)) / (0.6744897501960817::double * sqrt(6)) as noise from (
        select measurement_id, lag(intensity) over w as a, intensity as b, lead(intensity) over w as c
        from {source} window w as (partition by measurement_id order by pos))
    where a is not null and c is not null group by 1)
, levels as (
    select measurement_id, median(intensity) as level, max(intensity) - median(intensity) as signal from {source} group by 1)
, sides as (
    select measurement_id, pos, sign(intensity - level) as s from {source} join levels using (measurement_id)
    where intensity <> level)
, runs as (
    select measurement_id, 1 + count_if(s <> p) as runs, count_if(s > 0)::double as u, count_if(s < 0)::double as d from (
        select *, lag(s) over (partition by measurement_id order by pos) as p from sides) group by 1)
, quality as (
    select measurement_id, level, noise, signal, case when noise > 0 then signal / noise end as snr,
           case when u > 0 and d > 0 and 2 * u * d > u + d then
               (runs - 2 * u * d / (u + d) - 1) / sqrt(2 * u * d * (2 * u * d - u - d) / ((u + d) ** 2 * (u + d - 1))) end as runs_z
    from levels join bends using (measurement_id) left join runs using (measurement_id))
"""


SHOWN = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in QUALITY)

QUERIES = {
    "pixel_persistence": (
        pixel_persistence, with_tables("pixels", PERSISTENCE + "select * from persistence"),
    ),
    "broken_pixels": (broken_pixels, with_tables("pixels", PERSISTENCE + "select * from broken")),
    "integrate_unbroken": (
        integrate_unbroken,
        with_tables("geo", PERSISTENCE + UNBROKEN + PROFILE.format(source="binned", lo="q_lo", hi="q_hi", npt=NPT)),
    ),
    "cosmic_rays": (
        cosmic_rays,
        with_tables(
            "pixels",
            RAYS + "select measurement_id, r as row_idx, c as col_idx, v as value, mid as background, run from rays",
        ),
    ),
    "rays_removed": (
        rays_removed,
        with_tables(
            "pixels",
            RAYS + """select measurement_id, r as row_idx, c as col_idx, coalesce(rays.mid, dense.v) as value
            from dense left join rays using (measurement_id, r, c)""",
        ),
    ),
    "ring_harmonics": (ring_harmonics, with_tables("geo", HARMONICS + "select * from rings")),
    "asymmetry": (
        asymmetry,
        with_tables(
            "geo",
            HARMONICS.replace("round(sqrt", "(sqrt").replace("end, 6)", "end)")
            + f"""select measurement_id, count(n) as n_rings,
            {", ".join(f"round(sum(n * index_{k}) / sum(n), 6) as index_{k}" for k in range(1, ORDER + 1))}
            from (select *, case when n_pixels >= 8 and index_1 is not null then n_pixels end as n from rings)
            group by measurement_id""",
        ),
    ),
    "center_shape": (center_shape, CENTER_SHAPE),
    "peaks": (
        peaks,
        with_tables(
            "peaked",
            PEAKS + """select measurement_id, pos, round(place, 6) as place, round(y, 6) as height,
            round(prominence, 6) as prominence from peaks""",
        ),
    ),
    "peak_consistency": (peak_consistency, with_tables("peaked", PEAKS + CONSISTENCY)),
    "intensity_stability": (intensity_stability, with_tables("pixels", STABILITY)),
    "signal_quality": (
        signal_quality, with_tables("peaked", _quality_sql("peaked") + f"select measurement_id, {SHOWN} from quality"),
    ),
    "quality_verdict": (
        quality_verdict,
        with_tables(
            "profiles",
            _quality_sql("profiles") + """, kinds as (
                select *, ['tissue', 'background', 'empty', 'dark', 'other'][measurement_id % 5 + 1] as kind from quality)
            select measurement_id, kind, case kind
                when 'tissue' then coalesce(snr >= 2.2, signal > 0)
                when 'background' then coalesce(runs_z >= -1.0, true)
                when 'empty' then coalesce(runs_z >= -1.0, true)
                when 'dark' then coalesce(runs_z >= -1.0, true) and abs(level) <= 1.01 end as passed
            from kinds""",
        ),
    ),
}
