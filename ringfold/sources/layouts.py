"""The core tables with explicit schemas, and a layout that saves exchanges.

Pixels of an image are grouped and joined by ``measurement_id`` again and again.
A table bucketed by it is shuffled once, when it is written; groupings by
measurement (alone or with a bin), windows over its lines and joins with other
tables of the same buckets then plan no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import scratch_path

ID = "measurement_id"

# Columns that must be there are NOT NULL.
SCHEMAS = {
    "pixels": f"{ID} BIGINT NOT NULL, row_idx INT NOT NULL, col_idx INT NOT NULL, value DOUBLE, cal_id BIGINT",
    "images": f"{ID} BIGINT NOT NULL, measurement_data ARRAY<ARRAY<DOUBLE>>, cal_id BIGINT",
    "calibrations": (
        "cal_id BIGINT NOT NULL, distance_m DOUBLE, poni1 DOUBLE, poni2 DOUBLE, pixel1 DOUBLE, pixel2 DOUBLE, "
        "wavelength_nm DOUBLE, rot1 DOUBLE, rot2 DOUBLE, rot3 DOUBLE, ponifile STRING"
    ),
    "measurements": (
        f"{ID} BIGINT NOT NULL, patient_id BIGINT, type_measurement STRING, cancer_diagnosis BOOLEAN, age DOUBLE, "
        "thickness DOUBLE, cal_id BIGINT, calculated_distance DOUBLE, calibration_manual_distance DOUBLE"
    ),
    "profiles": f"{ID} BIGINT NOT NULL, pos INT NOT NULL, q DOUBLE, intensity DOUBLE",
    "profile_arrays": f"{ID} BIGINT NOT NULL, q_range ARRAY<DOUBLE>, radial_profile_data ARRAY<DOUBLE>",
}
# What lies side by side inside a bucket.
ORDER = {"pixels": [ID, "row_idx", "col_idx"], "profiles": [ID, "pos"]}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def conformed(df: DataFrame, name: str, extra: bool = False) -> DataFrame:
    """``df`` with the columns and types of a core table, in their order.

    An absent optional column is null; an absent required one is a ValueError. A
    value that a type cannot hold, and a null in a required column, fail the job.
    Further columns are dropped, or follow with ``extra``. Names are compared
    without case.
    """
    have = {c.lower(): c for c in df.columns}
    columns, missing = [], []
    for field in schema(name):
        own = have.pop(field.name, None)
        if own is None:
            missing += [] if field.nullable else [field.name]
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(f"`{own}`").cast(field.dataType)
        if not field.nullable:
            wrong = F.raise_error(F.lit(f"{name}: null in {field.name}")).cast(field.dataType)
            value = F.when(value.isNotNull(), value).otherwise(wrong)
        columns.append(value.alias(field.name))
    if missing:
        raise ValueError(f"{name}: no column {', '.join(missing)}")
    return df.select(*columns, *[F.col(f"`{c}`") for c in have.values() if extra])


def write_bucketed(
    df: DataFrame, name: str, buckets: int | None = None, table: str | None = None, path: str | None = None
) -> str:
    """Write a core table bucketed by measurement and return its table name.

    ``buckets`` follow the shuffle partitions by default. Rows are exchanged by
    the buckets' own hash first, so each task writes its own buckets: as many
    files as buckets, not tasks times buckets. Give ``table`` and ``path`` for a
    table that outlives the session; by default both are this application's own.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = table or f"core_{name}_{uuid.uuid4().hex}"
    rows = conformed(df, name, extra=True).repartition(buckets, ID)
    (
        rows.write.bucketBy(buckets, ID)
        .sortBy(*ORDER.get(name, [ID]))
        .option("path", path or scratch_path(spark, table))
        .saveAsTable(table)
    )
    return table


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A bucketed table, read bucket by bucket."""
    return spark.table(table)
