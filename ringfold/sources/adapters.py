"""Core tables read from, or derived by Spark from, a folder of parquet tables.

Every adapter is lazy and covers its whole input. Its SQL twin in
``ringfold.plans.oracle`` states the same table for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.skew import estimated_bytes, parts_for

# Shape of the derived detector images.
N_ROWS = 32
N_COLS = 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Bytes of the table behind ``pixels`` that one task aggregates.
PIXEL_BYTES = 8 << 20


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse detector images: one row per lit pixel.

    Rows are dealt out by position, in as many parts as the table is large, so a
    task holds a bounded number of pixels and one measurement is spread as well."""
    lines = table(spark, folder, "lineitem")
    place = ["measurement_id", "row_idx", "col_idx"]
    return (
        lines.select(
            F.expr("l_orderkey div 300").alias("measurement_id"),
            F.expr("cast(l_partkey % 32 as int)").alias("row_idx"),
            F.expr("cast(l_orderkey % 32 as int)").alias("col_idx"),
            "l_quantity",
        )
        .repartition(parts_for(lines, estimated_bytes(lines), PIXEL_BYTES), *place)
        .groupBy(*place)
        .agg(F.sum("l_quantity").alias("value"))
        .withColumn("cal_id", F.expr("measurement_id % 10"))
    )


def calibrations(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration dimension, as columns and as calibration text."""
    base = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("cal_id"),
        F.expr("160 + s_suppkey % 25").alias("mm"),
        F.expr("2345 + s_suppkey % 3 * 150").alias("um1"),
        F.expr("2281 - s_suppkey % 4 * 150").alias("um2"),
    )
    return base.select(
        "cal_id",
        (F.col("mm").cast("double") / 1e3).alias("distance_m"),
        (F.col("um1").cast("double") / 1e6).alias("poni1"),
        (F.col("um2").cast("double") / 1e6).alias("poni2"),
        F.lit(0.00015).alias("pixel1"),
        F.lit(0.00015).alias("pixel2"),
        F.lit(0.1542).alias("wavelength_nm"),
        F.concat_ws(
            "\n",
            F.lit("Detector: Detector"),
            F.lit('Detector_config: {"pixel1": 0.00015, "pixel2": 0.00015}'),
            F.concat(F.lit("Distance: 0."), F.col("mm").cast("string")),
            F.concat(F.lit("Poni1: 0.00"), F.col("um1").cast("string")),
            F.concat(F.lit("Poni2: 0.00"), F.col("um2").cast("string")),
            F.lit("Wavelength: 1.542e-10"),
        ).alias("ponifile"),
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Exposures with patient, diagnosis and gaps in the metadata."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    return orders.join(
        customer, orders["o_custkey"] == customer["c_custkey"]
    ).select(
        F.col("o_orderkey").alias("measurement_id"),
        F.col("o_custkey").alias("patient_id"),
        F.expr("case when o_orderstatus = 'F' then 'WAXS' else 'SAXS' end").alias(
            "type_measurement"
        ),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("cancer_diagnosis"),
        F.expr(
            "case when o_orderkey % 7 = 0 then null "
            "else cast(20 + o_custkey % 60 as double) end"
        ).alias("age"),
        F.expr("cast(o_orderkey % 40 as double)").alias("thickness"),
        F.expr(
            "case when o_orderkey % 11 = 0 then null else o_orderkey % 10 end"
        ).alias("cal_id"),
        F.expr(
            "case when o_orderkey % 13 = 0 then null "
            "when o_orderstatus = 'F' then 0.02D else 0.16D end"
        ).alias("calculated_distance"),
        F.expr(
            "case when o_orderstatus = 'F' then 20D else 160D end"
        ).alias("calibration_manual_distance"),
        F.col("o_totalprice").alias("raw_score"),
    )


def profile_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles in the array layout: one row per measurement."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("measurement_id"),
        F.transform("embedding", lambda x, i: (i + 1) * F.lit(0.1)).alias("q_range"),
        F.transform("embedding", lambda x: x.cast("double") + 1).alias(
            "radial_profile_data"
        ),
        F.col("label").cast("long").alias("label"),
        F.expr("vec_id % 40").alias("patient_id"),
        F.expr("case when vec_id % 2 = 0 then 'SAXS' else 'WAXS' end").alias(
            "type_measurement"
        ),
        (F.col("label") < 5).alias("cancer_diagnosis"),
        F.expr(
            "case when vec_id % 9 = 0 then null "
            "else cast(30 + vec_id % 40 as double) end"
        ).alias("age"),
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles in the long layout: one row per point."""
    arrays = profile_arrays(spark, folder)
    rest = [
        "measurement_id",
        "label",
        "patient_id",
        "type_measurement",
        "cancer_diagnosis",
    ]
    return arrays.select(
        *rest,
        F.size("radial_profile_data").alias("n_points"),
        F.posexplode("radial_profile_data").alias("pos", "intensity"),
    ).withColumn("q", (F.col("pos") + 1) * F.lit(0.1))


def peaked_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with a peak whose place depends on the label."""
    cen = F.col("label") * 0.3 + 2.0
    bump = 2.0 * F.exp(-F.pow(F.col("q") - cen, 2) / 0.5)
    return profiles(spark, folder).withColumn("intensity", F.col("intensity") + bump)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Binary labels with a score."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y_true"),
        F.col("n_chars").cast("double").alias("y_score"),
    )


def scored_models(spark: SparkSession, folder: str) -> DataFrame:
    """The same labels scored by five pseudo models."""
    return scored(spark, folder).select(
        F.explode(F.array(*[F.lit(m).cast("long") for m in range(5)])).alias(
            "model_id"
        ),
        "doc_id",
        "y_true",
        "y_score",
    ).withColumn(
        "y_score",
        F.expr("cast((cast(y_score as bigint) * (2 * model_id + 1)) % 10007 as double)"),
    )


def container_tables(
    spark: SparkSession, folder: str
) -> tuple[DataFrame, DataFrame]:
    """Extracted container nodes: (datasets, sections), attributes as maps.

    Regions are files and nations groups. Files with an even region key use the
    simple layout (sections at the root), the others nest them in groups.
    """
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    nodes = (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("file_name"),
            F.expr("case when r_regionkey % 2 = 1 then n_name end").alias("group_name"),
            F.expr(
                "case when s_suppkey % 4 = 0 then 'calibrations' "
                "when r_regionkey % 2 = 0 then 'measurements' "
                "else concat('measurements_', cast(s_suppkey % 2 as string)) end"
            ).alias("section"),
            F.col("s_name").alias("dataset_name"),
            "s_suppkey",
            "n_nationkey",
            "r_regionkey",
        )
    )
    datasets = nodes.select(
        "file_name",
        "group_name",
        "section",
        "dataset_name",
        F.expr(
            "case when section = 'calibrations' then map('k', cast(s_suppkey as string), "
            "'ponifile', concat('text of ', dataset_name)) "
            "else map('k', cast(s_suppkey as string)) end"
        ).alias("attrs"),
    )
    sections = nodes.groupBy("file_name", "group_name", "section").agg(
        F.max("r_regionkey").alias("r"), F.max("n_nationkey").alias("n")
    ).select(
        "file_name",
        "group_name",
        "section",
        F.expr(
            "case when section = 'calibrations' and r = 1 then "
            "map('ponifile', concat('shared ', group_name), 'k', 'cal') "
            "when r % 2 = 1 and n % 2 = 0 then map('k', concat('n', cast(n as string))) "
            "else cast(map() as map<string,string>) end"
        ).alias("attrs"),
    )
    return datasets, sections
