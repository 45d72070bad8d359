"""Core schemas and bucketed tables."""

import pytest
from pyspark.sql import Window, functions as F

from helpers import pixel_frame
from ringfold.sources import containers, layouts

ID = "measurement_id"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pixels(spark):
    return pixel_frame(spark, {i: [[1.0 * i, 2.0], [3.0, 4.0]] for i in range(12)}).repartition(5)


def test_groupings_of_a_bucketed_table_plan_no_exchange(spark):
    table = layouts.write_bucketed(pixels(spark), "pixels", buckets=4)
    px = layouts.read_bucketed(spark, table)
    assert px.count() == 48 and [f.name for f in px.schema] == [f.name for f in layouts.schema("pixels")]
    images = px.groupBy(ID).agg(F.sum("value").alias("all"))
    lines = px.groupBy(ID, "row_idx").agg(F.sum("value").alias("line"))
    line = Window.partitionBy(ID, "row_idx").orderBy("col_idx")
    for df in (images, lines, lines.join(images, ID), px.withColumn("n", F.row_number().over(line))):
        assert "hashpartitioning" not in plan_of(df)
    got = {r[ID]: r["all"] for r in images.collect()}
    assert got == {i: i + 9.0 for i in range(12)}
    assert len(px.inputFiles()) <= 4
    # an unbucketed table needs one
    assert "hashpartitioning" in plan_of(pixels(spark).groupBy(ID).count())


def test_conformed_columns(spark):
    rows = spark.createDataFrame([("7", "1", 2, 3.5, "x")], "MEASUREMENT_ID string, row_idx string, col_idx int, value double, note string")
    out = layouts.conformed(rows, "pixels")
    assert out.columns == [f.name for f in layouts.schema("pixels")]
    assert tuple(out.first()) == (7, 1, 2, 3.5, None)
    assert layouts.conformed(rows, "pixels", extra=True).columns[-1] == "note"
    assert layouts.conformed(rows.limit(0), "pixels").count() == 0
    with pytest.raises(ValueError, match="col_idx"):
        layouts.conformed(rows.drop("col_idx"), "pixels")
    with pytest.raises(Exception, match="null in row_idx"):
        layouts.conformed(rows.withColumn("row_idx", F.lit(None)), "pixels").collect()
    with pytest.raises(Exception):
        layouts.conformed(rows.withColumn("row_idx", F.lit("one")), "pixels").collect()


def test_both_tables_of_containers_are_united(spark):
    cal = [spark.createDataFrame([("a", 1)], "name string, k int"), spark.createDataFrame([("b", "t")], "name string, text string")]
    meas = [spark.createDataFrame([(1,)], "m int"), spark.createDataFrame([(2,), (3,)], "m int")]
    calibrations, measurements = containers.united(list(zip(cal, meas)))
    assert sorted(map(tuple, calibrations.collect())) == [("a", 1, None), ("b", None, "t")]
    assert sorted(r[0] for r in measurements.collect()) == [1, 2, 3]
