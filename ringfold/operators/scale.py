"""Normalization, scaling and group statistics of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import attach
from .integrate import FLAT, ID


def row_norm(curve: Column, norm: str = "l1") -> Column:
    if norm == "max":
        return F.array_max(F.transform(curve, F.abs))
    if norm == "l1":
        return F.aggregate(curve, F.lit(0.0), lambda a, x: a + F.abs(x))
    if norm == "l2":
        return F.sqrt(F.aggregate(curve, F.lit(0.0), lambda a, x: a + x * x))
    raise ValueError(f"unknown norm {norm!r}")


def normalized(curve: Column, norm: str = "l1") -> Column:
    """Divide a 1-D cell by its norm; a zero row stays as it is."""
    # zipping with the repeated norm computes it once a row, not once a value
    return F.zip_with(
        curve,
        F.array_repeat(row_norm(curve, norm), F.size(curve)),
        lambda x, size: F.when(size == 0, x).otherwise(x / size),
    )


def normalize_image(pixels: DataFrame, norm: str = "l1") -> DataFrame:
    """Divide a whole image by its norm."""
    value = F.col("value")
    measure = {
        "l1": F.sum(F.abs(value)),
        "l2": F.sqrt(F.sum(value * value)),
        "max": F.max(F.abs(value)),
    }[norm]
    norms = pixels.groupBy(ID).agg(measure.alias("_norm"))
    joined = attach(pixels, norms, [ID], ["row_idx", "col_idx"])
    return joined.withColumn(
        "value", F.when(F.col("_norm") == 0, value).otherwise(value / F.col("_norm"))
    ).drop("_norm")


def fit_scaler(
    df: DataFrame, column: str, by: str | None = None, kinds: list | None = None
) -> DataFrame:
    """Population mean and scale per position, as arrays: one row, or one per
    value of ``by`` (only those in ``kinds``, when given). Rows are combined per
    position before the shuffle; a position without variance has scale 1."""
    key = F.col(by) if by else F.lit("all")
    rows = df.select(key.alias("_kind"), F.posexplode(column).alias("_pos", "_x"))
    if kinds is not None:
        rows = rows.filter(F.col("_kind").isin(kinds))
    stats = rows.groupBy("_kind", "_pos").agg(
        F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_std")
    )
    scale = F.when(
        F.col("_std") > FLAT * F.abs("_mean"), F.col("_std")
    ).otherwise(1.0)
    points = F.sort_array(
        F.collect_list(F.struct("_pos", "_mean", scale.alias("_scale")))
    )
    return (
        stats.groupBy("_kind")
        .agg(points.alias("_points"))
        .select(
            F.col("_kind").alias("kind"),
            F.col("_points._mean").alias("mean"),
            F.col("_points._scale").alias("scale"),
        )
    )


def apply_scaler(
    df: DataFrame,
    scaler: DataFrame,
    column: str,
    out: str,
    by: str | None = None,
) -> DataFrame:
    """Standardize a column with fitted arrays; rows of a kind without a scaler
    get null. One scaler for all rows enters as a scalar subquery; a table of
    scalers is joined with salts, as a kind may hold any share of the rows."""
    if by is None:
        fitted = scaler.select(F.struct("mean", "scale")).scalar()
        rows = df.withColumn("_fitted", fitted)
    else:
        kinds = scaler.select(
            F.col("kind").alias("_kind"), F.struct("mean", "scale").alias("_fitted")
        )
        rows = df.withColumn("_kind", F.col(by).cast(kinds.schema["_kind"].dataType))
        rows = attach(rows, kinds, ["_kind"], [ID], "left").drop("_kind")
    mean, size = F.col("_fitted.mean"), F.col("_fitted.scale")
    centered = F.zip_with(column, mean, lambda x, m: x - m)
    scaled = F.zip_with(centered, size, lambda x, s: x / s)
    return rows.withColumn(out, scaled).drop("_fitted")


def standardize(df: DataFrame, column: str) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, column), column, column)


NORM = "radial_profile_data_norm"
SCALED = "radial_profile_data_norm_scaled"
TYPES = ["SAXS", "WAXS"]


def norm_scale(
    df: DataFrame,
    scaler: DataFrame | None = None,
    by: str = "type_measurement",
    kinds: list | None = None,
) -> DataFrame:
    """L1 norm, then a separate scaler per kind, fitted here if none is given."""
    rows = df.withColumn(NORM, normalized(F.col("radial_profile_data"), "l1"))
    if scaler is None:
        scaler = fit_scaler(rows, NORM, by, kinds)
    return apply_scaler(rows, scaler, NORM, SCALED, by)


def group_statistics(points: DataFrame, labels: list[str]) -> DataFrame:
    """Elementwise mean and std of the profiles of each label."""
    return points.groupBy(*labels, "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("q").alias("q"),
        F.avg("intensity").alias("mean"),
        F.stddev_pop("intensity").alias("std"),
    )


def model_matrix(df: DataFrame, column: str = SCALED) -> DataFrame:
    """Scaled profile, number of measurements of the patient and age (-1 when
    the column is missing), as one array."""
    counts = df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_entries"))
    age = F.col("age").cast("double") if "age" in df.columns else F.lit(-1.0)
    return (
        attach(df, counts, ["patient_id"], [ID])
        .withColumn(
            "model_row",
            F.concat(
                column, F.array(F.col("_entries").cast("double")), F.array(age)
            ),
        )
        .drop("_entries")
    )
