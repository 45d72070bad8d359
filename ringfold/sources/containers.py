"""Measurement containers as tables.

A container is a tree file -> [group ->] section -> dataset with attributes at
each level. Its nodes come as two tables: ``datasets`` (file_name, group_name,
section, dataset_name, attrs and any payload) and ``sections`` (file_name,
group_name, section, attrs). ``group_name`` is null at the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def merged(base: Column, override: Column) -> Column:
    """Union of two maps in which ``override`` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def prefixed(attrs: Column, prefix: str = "calib_") -> Column:
    return F.transform_keys(attrs, lambda k, _: F.concat(F.lit(prefix), k))


def _promote_text(attrs: Column) -> Column:
    """Rename calib_ponifile to ponifile."""
    text = F.lit("calib_ponifile")
    rest = F.map_filter(attrs, lambda k, _: ~k.isin("calib_ponifile", "ponifile"))
    return F.when(
        F.map_contains_key(attrs, "calib_ponifile"),
        F.map_concat(
            rest, F.create_map(F.lit("ponifile"), F.element_at(attrs, text))
        ),
    ).otherwise(attrs)


def _scopes(sections: DataFrame) -> DataFrame:
    """The readable (file, group) scopes. A file with both sections at its root
    is simple; otherwise each group with calibrations and some measurements_*
    counts and the rest is skipped."""
    found = sections.groupBy("file_name", "group_name").agg(
        F.bool_or(F.col("section") == "calibrations").alias("has_cal"),
        F.bool_or(F.col("section") == "measurements").alias("has_plain"),
        F.bool_or(F.col("section").startswith("measurements_")).alias("has_named"),
    )
    at_root = F.col("group_name").isNull()
    simple = F.col("has_cal") & F.col("has_plain") & at_root
    files = found.groupBy("file_name").agg(F.bool_or(simple).alias("simple"))
    return (
        found.join(files, "file_name")
        .filter(
            (F.col("simple") & at_root)
            | (~F.col("simple") & ~at_root & F.col("has_cal") & F.col("has_named"))
        )
        .select("file_name", "group_name", "simple")
    )


def flatten_containers(
    datasets: DataFrame, sections: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(calibrations, measurements) with inherited attributes in ``attrs``.

    Later wins: own attributes, then name and id, then the section's, then (for
    measurements) those of the calibration section under ``calib_``.
    """
    scopes = _scopes(sections)
    same_scope = ["file_name", "_scope"]

    def keyed(df: DataFrame) -> DataFrame:
        # groups and the root never share a key, whatever a group is called
        return df.withColumn(
            "_scope",
            F.coalesce(F.concat(F.lit("/"), F.col("group_name")), F.lit("")),
        )

    scopes = keyed(scopes).drop("group_name")
    parents = keyed(sections).select(
        "file_name", "_scope", "section", F.col("attrs").alias("_section")
    )
    shared = parents.filter(F.col("section") == "calibrations").select(
        "file_name", "_scope", prefixed(F.col("_section")).alias("_calib")
    )
    rows = (
        keyed(datasets)
        .join(scopes, same_scope)
        .join(parents, [*same_scope, "section"])
        .join(shared, same_scope)
    )
    container_id = F.coalesce(F.col("group_name"), F.lit("root"))

    def named(label: str) -> Column:
        return F.create_map(
            F.lit(label), F.col("dataset_name"), F.lit("id"), container_id
        )

    hidden = ["_scope", "_section", "_calib", "simple"]
    is_cal = F.col("section") == "calibrations"
    is_meas = F.when(
        F.col("simple"), F.col("section") == "measurements"
    ).otherwise(F.col("section").startswith("measurements_"))
    cal = merged(
        merged(prefixed(F.col("attrs")), named("cal_name")), F.col("_calib")
    )
    meas = merged(
        merged(merged(F.col("attrs"), named("meas_name")), F.col("_section")),
        F.col("_calib"),
    )
    calibrations = (
        rows.filter(is_cal).withColumn("attrs", _promote_text(cal)).drop(*hidden)
    )
    measurements = (
        rows.filter(is_meas).withColumn("attrs", _promote_text(meas)).drop(*hidden)
    )
    return calibrations, measurements


def attributes(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn attributes into columns; a missing one is null."""
    rest = [c for c in df.columns if c != "attrs"]
    return df.select(*rest, *[F.col("attrs").getItem(n).alias(n) for n in names])


def union_containers(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables of many containers; columns a table lacks are null."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    )


def united(
    tables: list[tuple[DataFrame, DataFrame]],
) -> tuple[DataFrame, DataFrame]:
    """(calibrations, measurements) of many containers, each as one table."""
    calibrations, measurements = zip(*tables)
    return union_containers(list(calibrations)), union_containers(list(measurements))


def read_described(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    arrays: DataFrame,
    key: str = "measurement_id",
) -> DataFrame:
    """A description CSV joined to the array stored for each measurement."""
    described = spark.read.csv(path, header=True, schema=schema)
    return described.join(arrays, key)


# Documented column names -> the names the operators use.
ALIASES = {
    "patientId": "patient_id",
    "isCancerDiagnosed": "cancer_diagnosis",
    "distanceInMM": "calibration_manual_distance",
    "pixelSize": "pixel_size",
    "studyName": "study_name",
    "exposureTime": "exposure",
    "timestamp": "measurement_timestamp",
}


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename documented column names, unless the canonical one exists."""
    return df.withColumnsRenamed(
        {
            old: new
            for old, new in ALIASES.items()
            if old in df.columns and new not in df.columns
        }
    )
