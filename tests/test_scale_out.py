"""Parts of pixels and fits are bounded, however large the tables are."""

import re

import pytest
from pyspark.sql import functions as F

from ringfold.functions.skew import parts_for
from ringfold.operators import deviation, fit, integrate, spectrum
from ringfold.plans import images, tables as registered
from ringfold.plans.fits import MODEL
from ringfold.plans.registry import REGISTRY
from ringfold.sources import adapters


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_amount(spark):
    df = spark.range(1)
    cores = spark.sparkContext.defaultParallelism
    assert parts_for(df, 0, 10) == parts_for(df, 10 * cores, 10) == cores
    assert parts_for(df, 1001, 10) == 101


def test_pixels_come_in_parts_of_a_bounded_size(spark, tmp_path, monkeypatch):
    lines = spark.range(3000).select(
        (F.col("id") * 7).alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"), F.lit(2.0).alias("l_quantity")
    )
    lines.unionByName(lines.limit(40)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    sums = {}
    for size in (1 << 30, 500):
        monkeypatch.setattr(adapters, "PIXEL_BYTES", size)
        out = adapters.pixels(spark, str(tmp_path))
        plan = exchanges(out)
        sums[size] = {(r["measurement_id"], r["row_idx"], r["col_idx"]): r["value"] for r in out.collect()}
        assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
        parts = out.select(F.spark_partition_id()).distinct().count()
        assert (parts > spark.sparkContext.defaultParallelism) == (size == 500)
    assert sums[500] == sums[1 << 30] and sum(sums[500].values()) == 6080


def test_joins_by_bin_send_no_copies(spark):
    cake = spark.range(200).select(
        (F.col("id") % 3).alias("measurement_id"), (F.col("id") % 5).cast("int").alias("chi_bin"),
        (F.col("id") % 7).cast("int").alias("pos"), F.col("id").cast("double").alias("intensity"),
    ).dropDuplicates(["measurement_id", "chi_bin", "pos"])
    binned = cake.select("measurement_id", "chi_bin", "pos", F.col("chi_bin").alias("row_idx"), F.col("pos").alias("col_idx"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        back = deviation.project_back(binned, deviation.cake_flags(cake))
        for df in (back, deviation.cake_deviation(cake), spectrum.percent_deviation(cake)):
            assert "Generate explode(sequence" not in exchanges(df) and "_salt" not in exchanges(df)
        assert back.count() == 105
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fit_deals_out_measurements_by_candidates(spark, monkeypatch):
    points = spark.range(6 * 20).select(
        (F.col("id") % 6).alias(integrate.ID), (F.col("id") / 6).cast("int").alias("pos")
    ).withColumn("q", F.col("pos") * 0.1).withColumn("intensity", F.exp(-F.pow(F.col("q") - 1.0, 2) / 0.5) + 1)
    plans, kept = [], fit.written

    def seen(df, label="step"):
        plans.append(exchanges(df))
        return kept(df, label)

    monkeypatch.setattr(fit, "written", seen)
    found = {}
    for most in (10**9, 60):
        monkeypatch.setattr(fit, "TASK_SUMS", most)
        out = fit.fit(points, MODEL, grid=3, rounds=1)
        found[most] = {r[integrate.ID]: [round(v, 9) for v in r["fit_params_all"]] for r in out.collect()}
    assert found[60] == found[10**9] and len(found[60]) == 6
    assert all("REPARTITION_BY_NUM" in plan for plan in plans) and len(plans) == 2


def tables(spark, folder, suppliers=30):
    """Lines and suppliers enough for images of three measurements."""
    spark.range(2400).select(
        (F.col("id") * 3 % 900).alias("l_orderkey"), (F.col("id") * 7 % 997).alias("l_partkey"),
        (F.col("id") % 11 + 1).cast("double").alias("l_quantity"),
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(suppliers).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def merges(spark):
    """No broadcast by the planner, and a number of shuffle partitions to choose."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"]
    before = {name: spark.conf.get(name) for name in names}

    def chosen(partitions):
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], str(partitions))

    yield chosen
    for name, value in before.items():
        spark.conf.set(name, value)


def copies(df):
    """The number of times each generator of salts repeats its rows."""
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("explode(") == plan.count("explode(sequence(cast(0 as bigint)")
    return [int(last) + 1 for last in re.findall(r"explode\(sequence\(cast\(0 as bigint\), cast\((\d+) as bigint\)", plan)]


def test_thickness_adjust_sends_few_copies(spark, tmp_path, merges):
    spark.range(400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    d = tables(spark, tmp_path)
    small = registered.thickness_adjust(spark, d)
    assert "_salt" not in exchanges(small)
    want = rows_of(small)
    assert len(want) == 400 - len(range(0, 400, 11))
    for partitions in (4, 400):
        merges(partitions)
        out = registered.thickness_adjust(spark, d)
        assert copies(out) == [8] and rows_of(out) == want


def test_deviation_cake_images_copies_calibrations_alone(spark, tmp_path, merges):
    d = tables(spark, tmp_path)
    want = rows_of(images.deviation_cake_images(spark, d))
    merges(400)
    # for the pixels, their cake, and the same cake again for its means
    assert copies(images.deviation_cake_images(spark, d)) == [8, 8, 8]
    merges(4)
    assert rows_of(images.deviation_cake_images(spark, d)) == want and want


@pytest.mark.parametrize("name", ["deviation", "deviation_cake", "deviation_wide", "hankel", "roughness"])
def test_queries_take_pixels_in_parts_of_a_bounded_size(spark, tmp_path, monkeypatch, name):
    d = tables(spark, tmp_path)
    size = adapters.estimated_bytes(adapters.table(spark, d, "lineitem"))
    found = {}
    for parts in (1, 40):
        monkeypatch.setattr(adapters, "PIXEL_BYTES", -(-size // parts))
        out = REGISTRY[name][0](spark, d)
        plan = exchanges(out)
        dealt = re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)
        assert {int(n) for n in dealt} == {max(spark.sparkContext.defaultParallelism, parts)}
        found[parts] = rows_of(out)
    assert found[1] == found[40] and found[1]
