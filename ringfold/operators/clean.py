"""Cleaning of measurement rows. Array cells are handled inside their row, so
nothing here shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.columns import finite

# The standard columns of a prepared measurement.
STANDARD_COLUMNS = [
    "calibration_measurement_id",
    "study_name",
    "study_id",
    "cancer_tissue",
    "cancer_diagnosis",
    "patient_id",
    "wavelength",
    "pixel_size",
    "calibration_manual_distance",
    "calculated_distance",
    "measurement_data",
    "center",
    "ponifile",
]


@dataclass(frozen=True)
class Limits:
    """q bounds of the two measurement types."""

    q_min_saxs: float
    q_max_saxs: float
    q_min_waxs: float
    q_max_waxs: float


@dataclass(frozen=True)
class RuleQ:
    """Keep rows whose intensity at ``q_value`` lies strictly inside bounds."""

    column_name: str
    q_column_name: str
    q_value: float
    lower: float | None = None
    upper: float | None = None
    cancer_diagnosis: bool | None = None


def is_nan_pair(pair: Column) -> Column:
    """Both fields of a two-field struct are NaN."""
    first, second = pair.getField("row"), pair.getField("col")
    return F.coalesce(F.isnan(first) & F.isnan(second), F.lit(False))


def is_all_none(array: Column) -> Column:
    return F.forall(array, lambda x: x.isNull())


def finite_image(image: Column) -> Column:
    return F.transform(
        image, lambda line: F.transform(line, lambda v: finite(F.coalesce(v, F.lit(0.0))))
    )


def type_by_distance(distance_m: Column) -> Column:
    return F.when(distance_m < 0.05, "WAXS").otherwise("SAXS")


def type_by_manual_distance(distance_mm: Column) -> Column:
    return F.when(distance_mm < 50, "WAXS").otherwise("SAXS")


def drop_uncalibrated(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["ponifile"])


def prepare(
    df: DataFrame, columns: list[str] | None = None, no_poni: bool = False
) -> DataFrame:
    """Drop unusable rows, repair cells, derive the type, keep ``columns``."""
    columns = list(STANDARD_COLUMNS if columns is None else columns)
    have = set(df.columns)
    if "center" in have:
        df = df.filter(F.col("center").isNotNull())
    if no_poni:
        columns = [c for c in columns if c != "ponifile"]
        if "calculated_distance" in have:
            df = df.filter(
                F.col("calculated_distance").isNotNull()
                & ~F.isnan("calculated_distance")
            )
    elif "ponifile" in have:
        df = drop_uncalibrated(df)
    if "age" in have:
        df = df.withColumn("age", F.coalesce(F.nanvl("age", F.lit(-1.0)), F.lit(-1.0)))
    if "measurement_data" in have:
        df = df.withColumn("measurement_data", finite_image(F.col("measurement_data")))
    if "calculated_distance" in have:
        df = df.withColumn(
            "type_measurement", type_by_distance(F.col("calculated_distance"))
        )
    return df.select(*columns)


def set_q_range(df: DataFrame, limits: Limits | None) -> DataFrame:
    """Add ``interpolation_q_range`` (min, max) by measurement type."""
    if limits is None:
        return df
    if "type_measurement" not in df.columns:
        df = df.withColumn(
            "type_measurement",
            type_by_manual_distance(F.col("calibration_manual_distance")),
        )

    def pair(low: float, high: float) -> Column:
        return F.struct(
            F.lit(float(low)).alias("q_min"), F.lit(float(high)).alias("q_max")
        )

    return df.withColumn(
        "interpolation_q_range",
        F.when(
            F.col("type_measurement") == "WAXS",
            pair(limits.q_min_waxs, limits.q_max_waxs),
        ).otherwise(pair(limits.q_min_saxs, limits.q_max_saxs)),
    )


def intensity_at(values: Column, q: Column, q_value: float) -> Column:
    """Value at the first position nearest to ``q_value``."""
    distance = F.transform(q, lambda x: F.abs(x - q_value))
    return F.get(values, F.array_position(distance, F.array_min(distance)).cast("int") - 1)


def clean_q(df: DataFrame, rules: list[RuleQ]) -> DataFrame:
    """Apply the rules in turn. A profile that ends below ``q_value`` is kept,
    a rule without bounds keeps nothing else."""
    for rule in rules:
        if not isinstance(rule, RuleQ):
            raise TypeError(f"not a cleaning rule: {rule!r}")
        q = F.col(rule.q_column_name)
        intensity = intensity_at(F.col(rule.column_name), q, rule.q_value)
        tests = []
        if rule.lower is not None:
            tests.append(intensity > rule.lower)
        if rule.upper is not None:
            tests.append(intensity < rule.upper)
        inside = F.lit(bool(tests))
        for test in tests:
            inside = inside & test
        too_short = F.get(q, F.size(q) - 1) < rule.q_value
        df = df.filter(F.coalesce(too_short | inside, F.lit(False)))
    return df


def infer_label(df: DataFrame, y_column: str, y_value=None) -> Column:
    """The label column, or whether it equals ``y_value``."""
    column = F.col(y_column)
    return column if y_value is None else column == F.lit(y_value)


def extract_features(
    df: DataFrame, columns: list[str], name: str = "features"
) -> DataFrame:
    """Concatenate scalar, 1-D and 2-D columns into one array of doubles."""
    parts = []
    for column in columns:
        kind = df.schema[column].dataType
        value = F.col(column)
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, ArrayType):
                value = F.flatten(value)
            parts.append(value.cast(ArrayType(DoubleType())))
        else:
            parts.append(F.array(value.cast("double")))
    return df.withColumn(name, F.concat(*parts))
