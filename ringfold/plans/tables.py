"""Registered queries over containers, calibration texts and measurement rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import finite, tidy
from ..functions.lineage import scratch_path
from ..operators import calibration, clean
from ..sources import adapters, containers, layouts
from .oracle import with_tables

ID = "measurement_id"


def _container_rows(df, label):
    rows = containers.attributes(df, [label, "id", "k", "calib_k", "ponifile"])
    return rows.select(
        "file_name",
        "section",
        F.col(label).alias("name"),
        "id",
        "k",
        "calib_k",
        "ponifile",
    )


def container_flatten(spark, d):
    cal, meas = containers.flatten_containers(*adapters.container_tables(spark, d))
    return _container_rows(cal, "cal_name").unionByName(
        _container_rows(meas, "meas_name")
    )


NODES = """
with nodes as (
    select r_name as file_name, case when r_regionkey % 2 = 1 then n_name end as grp,
           case when s_suppkey % 4 = 0 then 'calibrations'
                when r_regionkey % 2 = 0 then 'measurements'
                else 'measurements_' || (s_suppkey % 2) end as section,
           s_name as name, s_suppkey, n_nationkey, r_regionkey
    from supplier join nation on s_nationkey = n_nationkey
         join region on n_regionkey = r_regionkey)
, sections as (
    select file_name, grp, section, max(r_regionkey) as r, max(n_nationkey) as n
    from nodes group by all)
, shared as (
    select file_name, grp,
           case when r = 1 then 'cal' when r % 2 = 1 and n % 2 = 0 then 'n' || n end as ck,
           case when r = 1 then 'shared ' || grp end as ctext
    from sections where section = 'calibrations')
, own as (
    select file_name, grp, section,
           case when section = 'calibrations' and r = 1 then 'cal'
                when r % 2 = 1 and n % 2 = 0 then 'n' || n end as gk
    from sections)
, open as (
    select distinct s.file_name, s.grp from shared s join nodes m
    on m.file_name = s.file_name and m.grp is not distinct from s.grp
       and m.section like 'measurements%')
, flat as (
    select n.file_name, n.section, n.name, coalesce(n.grp, 'root') as id,
           case when n.section = 'calibrations' then null
                else coalesce(own.gk, n.s_suppkey::varchar) end as k,
           case when n.section = 'calibrations' then coalesce(shared.ck, n.s_suppkey::varchar)
                else shared.ck end as calib_k,
           case when n.section = 'calibrations' then coalesce(shared.ctext, 'text of ' || n.name)
                else shared.ctext end as ponifile
    from nodes n
    join open on open.file_name = n.file_name and open.grp is not distinct from n.grp
    join own on own.file_name = n.file_name and own.grp is not distinct from n.grp
         and own.section = n.section
    join shared on shared.file_name = n.file_name and shared.grp is not distinct from n.grp)
"""


def container_union(spark, d):
    _, meas = containers.flatten_containers(*adapters.container_tables(spark, d))
    simple = containers.attributes(
        meas.filter("group_name is null"), ["meas_name", "k"]
    )
    nested = containers.attributes(
        meas.filter("group_name is not null"), ["meas_name", "id", "ponifile"]
    )
    return containers.union_containers([simple, nested]).select(
        "file_name", "meas_name", "k", "id", "ponifile"
    )


def container_union_calibrations(spark, d):
    """Both tables of the two layouts united; the calibrations are shown."""
    cal, meas = containers.flatten_containers(*adapters.container_tables(spark, d))
    simple, nested = "group_name is null", "group_name is not null"
    calibrations, _ = containers.united(
        [
            (
                containers.attributes(cal.filter(simple), ["cal_name", "calib_k", "ponifile"]),
                containers.attributes(meas.filter(simple), ["meas_name", "k"]),
            ),
            (
                containers.attributes(cal.filter(nested), ["cal_name", "id", "calib_k", "ponifile"]),
                containers.attributes(meas.filter(nested), ["meas_name", "id", "ponifile"]),
            ),
        ]
    )
    return calibrations.select("file_name", "cal_name", "id", "calib_k", "ponifile")


def bucketed_lines(spark, d):
    """Share of each detector line in its image, from pixels bucketed by
    measurement: both groupings and their join plan no exchange."""
    table = layouts.write_bucketed(adapters.pixels(spark, d), "pixels")
    px = layouts.read_bucketed(spark, table)
    images = px.groupBy(ID).agg(F.sum("value").alias("_all"))
    lines = px.groupBy(ID, "row_idx").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("value").alias("value"))
    return lines.join(images, ID).select(
        ID, "row_idx", "n_pixels", "value", tidy(F.col("value") / F.col("_all")).alias("share")
    )


def conformed_measurements(spark, d):
    """Measurements brought to their core schema from other names and types."""
    rows = adapters.measurements(spark, d).select(
        F.col("measurement_id").cast("string").alias("Measurement_ID"), "patient_id", "cancer_diagnosis",
        F.col("age").cast("int").alias("age"), "raw_score",
    )
    return layouts.conformed(rows, "measurements", extra=True).drop("type_measurement", "calculated_distance")


def describe_join(spark, d):
    arrays = adapters.profile_arrays(spark, d)
    path = scratch_path(spark, "described")
    arrays.select(ID, "label", "type_measurement", "age").write.csv(path, header=True)
    joined = containers.read_described(
        spark,
        path,
        "measurement_id bigint, label bigint, type_measurement string, age double",
        arrays.select(ID, "radial_profile_data"),
    )
    return joined.select(
        ID,
        "label",
        "type_measurement",
        "age",
        F.size("radial_profile_data").cast("long").alias("n_points"),
        F.posexplode("radial_profile_data").alias("pos", "point"),
    ).withColumns({"pos": F.col("pos").cast("long"), "point": tidy("point")})


DESCRIBE_JOIN = with_tables(
    "profiles",
    """
select measurement_id, label, type_measurement, age, n_points, pos, round(intensity, 6) as point
from profiles""",
)


def _exposed(spark, d):
    """Measurements with calibration text; unmatched ones keep a null text."""
    cal = adapters.calibrations(spark, d).select("cal_id", "ponifile")
    return adapters.measurements(spark, d).join(cal, "cal_id", "left").withColumn(
        "center",
        F.when(
            F.col(ID) % 17 != 0,
            F.struct(F.lit(15.5).alias("row"), F.lit(16.5).alias("col")),
        ),
    )


PREPARED = [ID, "patient_id", "age", "type_measurement", "calculated_distance", "ponifile"]


def data_preparation(spark, d):
    return clean.prepare(_exposed(spark, d), PREPARED)


def data_preparation_no_poni(spark, d):
    return clean.prepare(_exposed(spark, d), PREPARED, no_poni=True)


PREPARE = """
select measurement_id, patient_id, coalesce(age, -1) as age,
       case when calculated_distance < 0.05 then 'WAXS' else 'SAXS' end as type_measurement,
       calculated_distance{text}
from measurements left join calibrations using (cal_id)
where measurement_id % 17 <> 0 and {keep}"""


def drop_missing_ponifile(spark, d):
    return clean.drop_uncalibrated(_exposed(spark, d)).select(ID, "ponifile")


def _spoilt(spark, d):
    return adapters.pixels(spark, d).withColumn(
        "value",
        F.expr(
            "case when value % 7 = 0 then double('NaN') when value % 11 = 0 "
            "then double('Infinity') when value % 13 = 0 then double('-Infinity') "
            "else value end"
        ),
    )


def nan_to_num(spark, d):
    return _spoilt(spark, d).select(
        ID, "row_idx", "col_idx", finite(F.col("value")).alias("value")
    )


NAN_TO_NUM = with_tables(
    "pixels",
    """
select measurement_id, row_idx, col_idx,
       case when value % 7 = 0 then 0 when value % 11 = 0 then 1.7976931348623157e308
            when value % 13 = 0 then -1.7976931348623157e308 else value end as value
from pixels""",
)


def type_by_distance(spark, d):
    return adapters.measurements(spark, d).select(
        ID,
        clean.type_by_distance(F.col("calculated_distance")).alias("by_distance"),
        clean.type_by_manual_distance(F.col("calibration_manual_distance")).alias(
            "by_manual_distance"
        ),
    )


TYPE_BY_DISTANCE = with_tables(
    "measurements",
    """
select measurement_id,
       if(coalesce(calculated_distance, 1) < 0.05, 'WAXS', 'SAXS') as by_distance,
       if(calibration_manual_distance < 50, 'WAXS', 'SAXS') as by_manual_distance
from measurements""",
)


def q_range_set(spark, d):
    limits = clean.Limits(0.1, 2.5, 3.0, 21.5)
    rows = adapters.measurements(spark, d).drop("type_measurement")
    return clean.set_q_range(rows, limits).select(
        ID, "type_measurement", "interpolation_q_range.q_min", "interpolation_q_range.q_max"
    )


Q_RANGE_SET = with_tables(
    "measurements",
    """
select measurement_id, type_measurement,
       case type_measurement when 'WAXS' then 3.0::double else 0.1::double end as q_min,
       case type_measurement when 'WAXS' then 21.5::double else 2.5::double end as q_max
from measurements""",
)


def rule_q_filter(spark, d):
    rules = [
        clean.RuleQ("radial_profile_data", "q_range", 2.04, lower=0.9),
        clean.RuleQ("radial_profile_data", "q_range", 4.51, upper=1.1),
        clean.RuleQ("radial_profile_data", "q_range", 99.0, lower=5.0),
    ]
    return clean.clean_q(adapters.profile_arrays(spark, d), rules).select(ID, "label")


RULE_Q = with_tables(
    "profiles",
    """
, nearest as (
    select measurement_id, any_value(label) as label,
           arg_min(intensity, abs(q - 2.04)) as a, arg_min(intensity, abs(q - 4.51)) as b
    from profiles group by 1)
select measurement_id, label from nearest where a > 0.9 and b < 1.1""",
)


def infer_label(spark, d):
    rows = adapters.measurements(spark, d)
    return rows.select(
        ID,
        clean.infer_label(rows, "cancer_diagnosis").alias("y_plain"),
        clean.infer_label(rows, "type_measurement", "WAXS").alias("y_equal"),
    )


INFER_LABEL = with_tables(
    "measurements",
    "select measurement_id, cancer_diagnosis as y_plain, type_measurement = 'WAXS' as y_equal from measurements",
)


def column_extract(spark, d):
    rows = adapters.profile_arrays(spark, d).withColumn(
        "image", F.array("q_range", "radial_profile_data")
    )
    out = clean.extract_features(rows, ["label", "radial_profile_data", "image"])
    return out.select(
        ID, F.posexplode("features").alias("feature", "value")
    ).select(ID, F.col("feature").cast("long").alias("feature"), tidy("value").alias("value"))


COLUMN_EXTRACT = with_tables(
    "profiles",
    """
select distinct measurement_id, 0::bigint as feature, label::double as value from profiles
union all select measurement_id, 1 + pos, round(intensity, 6) from profiles
union all select measurement_id, 1 + n_points + pos, round(q, 6) from profiles
union all select measurement_id, 1 + 2 * n_points + pos, round(intensity, 6) from profiles""",
)


def predicates(spark, d):
    rows = adapters.profile_arrays(spark, d).select(
        ID,
        F.transform(
            "radial_profile_data",
            lambda v: F.when((F.col("label") != 3) & (v > 0.8), v),
        ).alias("cells"),
        F.struct(
            F.when(F.col("label") % 2 == 0, float("nan")).otherwise(1.0).alias("row"),
            F.when(F.col("label") % 3 == 0, float("nan")).otherwise(1.0).alias("col"),
        ).alias("center"),
    )
    return rows.select(
        ID,
        clean.is_all_none(F.col("cells")).alias("all_none"),
        clean.is_nan_pair(F.col("center")).alias("nan_pair"),
    )


PREDICATES = with_tables(
    "profiles",
    """
select measurement_id, bool_and(label = 3 or intensity <= 0.8) as all_none,
       any_value(label) % 6 = 0 as nan_pair
from profiles group by measurement_id""",
)


def poni_center(spark, d):
    parsed = calibration.parse_text(
        adapters.calibrations(spark, d).select("cal_id", "ponifile")
    )
    return calibration.with_center(parsed).select(
        "cal_id", tidy("center_x").alias("center_x"), tidy("center_y").alias("center_y")
    )


def poni_distance(spark, d):
    parsed = calibration.parse_text(
        adapters.calibrations(spark, d).select("cal_id", "ponifile")
    )
    return parsed.select("cal_id", tidy("distance_m").alias("distance_m"))


def poni_from_pixels(spark, d):
    parsed = calibration.parse_text(
        adapters.calibrations(spark, d).select("cal_id", "ponifile")
    )
    moved = calibration.poni_from_pixels(
        parsed, F.expr("cal_id % 30 + 0.5D"), F.expr("cal_id % 20 + 0.25D")
    )
    return moved.select(
        "cal_id", tidy("poni1", 9).alias("poni1"), tidy("poni2", 9).alias("poni2")
    )


def poni_scale(spark, d):
    parsed = calibration.parse_text(
        adapters.calibrations(spark, d).select("cal_id", "ponifile")
    )
    scaled = calibration.scale_poni(parsed, 0.14 / F.col("distance_m"))
    return scaled.select(
        "cal_id", tidy("poni1", 9).alias("poni1"), tidy("poni2", 9).alias("poni2")
    )


def poni_substitute(spark, d):
    cal = adapters.calibrations(spark, d)
    text = calibration.substitute_poni(
        F.col("ponifile"), F.col("poni1") * 2, F.col("poni2") + 0.001
    )
    return cal.select("cal_id", text.alias("ponifile"))


PONI_SUBSTITUTE = with_tables(
    "calibrations",
    r"""
select cal_id, regexp_replace(regexp_replace(ponifile,
           'Poni1:[^\n]*', 'Poni1:' || rtrim(printf('%.12f', poni1 * 2), '0')),
           'Poni2:[^\n]*', 'Poni2:' || rtrim(printf('%.12f', poni2 + 0.001), '0')) as ponifile
from calibrations""",
)


def poni_format(spark, d):
    cal = adapters.calibrations(spark, d)
    one_line = F.when(
        F.col("cal_id") % 3 != 0, F.regexp_replace("ponifile", "\n", " ")
    ).otherwise(F.col("ponifile"))
    return cal.select("cal_id", calibration.format_text(one_line).alias("ponifile"))


def thickness_adjust(spark, d):
    rows = calibration.attach_calibration(
        adapters.measurements(spark, d).filter("cal_id is not null"),
        adapters.calibrations(spark, d).select("cal_id", "ponifile"),
    )
    distance = calibration.thickness_distance(F.col("thickness"), 700.0)
    text = calibration.substitute(
        F.col("ponifile"), "Distance", F.format_string("%.6f", distance)
    )
    return rows.select(
        ID, distance.alias("distance_m"), text.alias("ponifile")
    )


THICKNESS_ADJUST = with_tables(
    "measurements calibrations",
    r"""
select measurement_id, round((700 - thickness / 2) / 1000, 6) as distance_m,
       'Detector: Detector' || chr(10)
       || 'Detector_config: {"pixel1": 0.00015, "pixel2": 0.00015}' || chr(10)
       || 'Distance:' || printf('%.6f', (700 - thickness / 2) / 1000)
       || chr(10) || string_split(ponifile, chr(10))[4] || chr(10) || string_split(ponifile, chr(10))[5]
       || chr(10) || string_split(ponifile, chr(10))[6] as ponifile
from measurements join calibrations using (cal_id)""",
)

QUERIES = {
    "container_flatten": (container_flatten, NODES + "select * from flat"),
    "container_union": (
        container_union,
        NODES
        + """
select file_name, name as meas_name, case when id = 'root' then k end as k,
       case when id <> 'root' then id end as id,
       case when id <> 'root' then ponifile end as ponifile
from flat where section <> 'calibrations'""",
    ),
    "container_union_calibrations": (
        container_union_calibrations,
        NODES
        + """
select file_name, name as cal_name, case when id <> 'root' then id end as id, calib_k, ponifile
from flat where section = 'calibrations'""",
    ),
    "bucketed_lines": (
        bucketed_lines,
        with_tables(
            "pixels",
            """select measurement_id, row_idx, count(*) as n_pixels, sum(value) as value,
            round(sum(value) / sum(sum(value)) over (partition by measurement_id), 6) as share
            from pixels group by measurement_id, row_idx""",
        ),
    ),
    "conformed_measurements": (
        conformed_measurements,
        with_tables(
            "measurements",
            """select measurement_id, patient_id, cancer_diagnosis, age, null::double as thickness,
            null::bigint as cal_id, null::double as calibration_manual_distance, raw_score from measurements""",
        ),
    ),
    "describe_join": (describe_join, DESCRIBE_JOIN),
    "data_preparation": (
        data_preparation,
        with_tables(
            "measurements calibrations",
            PREPARE.format(text=", ponifile", keep="ponifile is not null"),
        ),
    ),
    "data_preparation_no_poni": (
        data_preparation_no_poni,
        with_tables(
            "measurements calibrations",
            PREPARE.format(text="", keep="calculated_distance is not null"),
        ),
    ),
    "drop_missing_ponifile": (
        drop_missing_ponifile,
        with_tables(
            "measurements calibrations",
            "select measurement_id, ponifile from measurements join calibrations using (cal_id)",
        ),
    ),
    "nan_to_num": (nan_to_num, NAN_TO_NUM),
    "type_by_distance": (type_by_distance, TYPE_BY_DISTANCE),
    "q_range_set": (q_range_set, Q_RANGE_SET),
    "rule_q_filter": (rule_q_filter, RULE_Q),
    "infer_label": (infer_label, INFER_LABEL),
    "column_extract": (column_extract, COLUMN_EXTRACT),
    "predicates": (predicates, PREDICATES),
    "poni_center": (
        poni_center,
        with_tables(
            "calibrations",
            "select cal_id, round(poni2 / pixel2, 6) as center_x, round(poni1 / pixel1, 6) as center_y from calibrations",
        ),
    ),
    "poni_distance": (
        poni_distance,
        with_tables(
            "calibrations",
            r"select cal_id, regexp_extract(ponifile, 'Distance:\s*(\S+)', 1)::double as distance_m from calibrations",
        ),
    ),
    "poni_from_pixels": (
        poni_from_pixels,
        with_tables(
            "calibrations",
            """select cal_id, round((cal_id % 20 + 0.25::double) * pixel1, 9) as poni1,
                      round((cal_id % 30 + 0.5::double) * pixel2, 9) as poni2 from calibrations""",
        ),
    ),
    "poni_scale": (
        poni_scale,
        with_tables(
            "calibrations",
            """select cal_id, round(poni1 * (0.14::double / distance_m), 9) as poni1,
                      round(poni2 * (0.14::double / distance_m), 9) as poni2 from calibrations""",
        ),
    ),
    "poni_substitute": (poni_substitute, PONI_SUBSTITUTE),
    "poni_format": (
        poni_format,
        with_tables("calibrations", "select cal_id, ponifile from calibrations"),
    ),
    "thickness_adjust": (thickness_adjust, THICKNESS_ADJUST),
}
