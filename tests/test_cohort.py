import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.functions.skew import attach
from ringfold.operators import calibration, cluster, evaluate, patients, split
from ringfold.sources import containers


def scored(spark, y, s):
    return spark.createDataFrame(
        [(int(a), float(b)) for a, b in zip(y, s)], "y_true int, y_score double"
    )


def test_roc_by_hand(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    points = evaluate.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert [(r["threshold"], r["fpr"], r["tpr"]) for r in points] == [
        (float("inf"), 0, 0), (0.8, 0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1), (0.1, 1, 1),
    ]
    assert evaluate.roc_auc(evaluate.score_groups(df)).first()[0] == 0.75
    assert evaluate.optimal_threshold(evaluate.roc_curve(df)).first()["threshold"] == 0.8


def test_collinear_points_are_dropped(spark):
    df = scored(spark, [1, 1, 1, 0, 0], [5, 4, 3, 2, 1])
    got = sorted(r["threshold"] for r in evaluate.roc_curve(df).collect())
    assert got == [1, 3, 5, float("inf")]


def test_buckets_do_not_change_the_curve(spark):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 300, 3000) / 10.0
    s[:1000] = 7.5  # one score shared by a third of the rows
    df = scored(spark, rng.integers(0, 2, 3000), s)
    want = None
    for buckets in (1, 7, 256):
        rows = sorted(tuple(r) for r in evaluate.roc_curve(df, None, buckets).collect())
        want = want or rows
        assert rows == want


def test_validate_perfect_scores(spark):
    row = evaluate.validate(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.7, 0.9])).first()
    # predictions are strictly above the threshold, rates count it in
    assert row["roc_auc"] == 100 and row["sensitivity"] == 100 and row["accuracy"] == 0.75
    only = evaluate.validate(scored(spark, [0, 1], [0.1, 0.9]), metrics=("accuracy",))
    assert only.columns == ["optimal_threshold", "accuracy"]


def test_balanced_split_never_straddles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 60)), bool(rng.integers(0, 2))) for i in range(900)]
    rows += [(900 + i, 99, True) for i in range(450)]  # one patient, a third of the rows
    df = spark.createDataFrame(rows, "measurement_id long, patient_id long, cancer_diagnosis boolean")
    train, test = split.split_patient_balanced(df, 0.3, 1)
    a = {r[0] for r in train.select("patient_id").distinct().collect()}
    b = {r[0] for r in test.select("patient_id").distinct().collect()}
    assert not a & b and train.count() + test.count() == 1350
    train, test = split.split_stratified_patients(
        df.withColumn("cancer_diagnosis", F.col("patient_id") % 2 == 0), 0.4, 1
    )
    assert train.count() + test.count() == 1350


def test_pairwise_distance_in_blocks(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.random((40, 3)), 1: rng.random((1, 3)), 2: rng.random((2, 3))}
    rows, i = [], 0
    for g, points in groups.items():
        for p in points:
            rows.append((i, g, p.tolist()))
            i += 1
    df = spark.createDataFrame(rows, "measurement_id long, g long, v array<double>")
    for block in (7, 1000):
        out = patients.pairwise_mean_distance(df, ["g"], "v", block)
        got = {r["g"]: r["mean_distance"] for r in out.collect()}
        for g, points in groups.items():
            d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
            pairs = d[np.triu_indices(len(points), 1)]
            assert got[g] == (pytest.approx(pairs.mean()) if pairs.size else None)


def clusters(spark, labels, values):
    return spark.createDataFrame(
        list(zip(labels, values)), "q_cluster_label int, q_range_max int"
    )


@pytest.mark.parametrize(
    "labels,values,threshold,direction,removed",
    [
        ([1] * 4 + [2] * 4, [100, 104, 98, 102, 7, 9, 8, 6], 2.5, "both", []),
        ([4] * 4 + [5] * 4, [20, 21, 19, 90, 40, 41, 42, 130], 1.5, "positive", [90, 130]),
        ([4] * 4 + [5] * 4, [20, 21, 19, -60, 40, 41, 42, -90], 1.5, "negative", [-90, -60]),
        ([7] * 5, [300, 1, 2, 3, -300], 1.2, "both", [-300, 300]),
    ],
)
def test_outliers(spark, labels, values, threshold, direction, removed):
    df = clusters(spark, labels, values)
    out = [r[1] for r in cluster.remove_outliers(df, threshold, direction).collect()]
    assert sorted(out + removed) == sorted(values)


def test_outlier_direction_is_checked(spark):
    with pytest.raises(ValueError, match="Invalid direction. Use 'both', 'positive', or 'negative'."):
        cluster.remove_outliers(clusters(spark, [0], [1]), 1.0, "invalid")


def test_cluster_range(spark):
    df = clusters(spark, [5, 5, 9, 9], [60, 40, 200, 500])
    out = cluster.cluster_q_range(df, 0.1, 0.9).collect()
    got = {r[0]: tuple(r["interpolation_q_range"]) for r in out}
    assert got[5] == pytest.approx((4, 36)) and got[9] == pytest.approx((20, 180))


def test_container_precedence(spark):
    datasets = spark.createDataFrame(
        [
            ("f", None, "calibrations", "c1", {"a": "own", "ponifile": "own text"}),
            ("f", None, "measurements", "m1", {"a": "own", "b": "own"}),
            ("g", "x", "calibrations", "c2", {"a": "own"}),
            ("g", "x", "measurements_1", "m2", {"a": "own"}),
            ("g", "y", "measurements_1", "m3", {"a": "own"}),
        ],
        "file_name string, group_name string, section string, dataset_name string, "
        "attrs map<string,string>",
    )
    sections = spark.createDataFrame(
        [
            ("f", None, "calibrations", {"a": "cal", "ponifile": "shared"}),
            ("f", None, "measurements", {"b": "group", "id": "mine"}),
            ("g", "x", "calibrations", {}),
            ("g", "x", "measurements_1", {}),
            ("g", "y", "measurements_1", {}),
        ],
        "file_name string, group_name string, section string, attrs map<string,string>",
    )
    cal, meas = containers.flatten_containers(datasets, sections)
    c = {r["dataset_name"]: r["attrs"] for r in cal.collect()}
    m = {r["dataset_name"]: r["attrs"] for r in meas.collect()}
    assert c["c1"] == {"calib_a": "cal", "ponifile": "shared", "cal_name": "c1", "id": "root"}
    assert m["m1"] == {
        "a": "own", "b": "group", "meas_name": "m1", "id": "mine",
        "calib_a": "cal", "ponifile": "shared",
    }
    assert c["c2"]["id"] == "x" and m["m2"]["id"] == "x"
    assert "m3" not in m


def test_calibration_text(spark):
    flat = "Detector: D Detector_config: {\"pixel1\": 1e-4} Distance: 0.5 Poni1: 0.1 Rot1: 0 Wavelength: 1e-10"
    df = spark.createDataFrame([(flat,), ("a\nb",)], "t string")
    got = [r[0] for r in df.select(calibration.format_text(F.col("t"))).collect()]
    assert got[0].split("\n") == [
        "Detector: D", 'Detector_config: {"pixel1": 1e-4}', "Distance: 0.5", "Poni1: 0.1",
        "Rot1: 0", "Wavelength: 1e-10",
    ]
    assert got[1] == "a\nb"
    bad = spark.createDataFrame([("nothing here",)], "ponifile string")
    assert calibration.parse_text(bad).first()["distance_m"] is None


def test_roc_of_two_columns_sorted(spark, tmp_path):
    df = scored(spark, [0, 1, 1, 0, 1], [0.2, 0.9, 0.4, 0.4, 0.1])
    path = str(tmp_path / "scored")
    df.write.parquet(path)
    for rows in (df, spark.read.parquet(path)):
        points = evaluate.roc_curve(rows).orderBy(F.desc("threshold")).collect()
        assert [(r["tp"], r["fp"]) for r in points] == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 2)]


def test_counts_beyond_four_billion(spark):
    """Four billion rows of each class: the curve of counts, without the rows."""
    many = 4_000_000_000
    groups = spark.createDataFrame(
        [(0.9, many, 0, 0, 0, (0, many), many, many), (0.1, 0, many, many, 0, None, many, many)],
        "threshold double, pos long, neg long, pos_above long, neg_above long,"
        "next struct<pos:long,neg:long>, p_all long, n_all long",
    )
    assert evaluate.roc_auc(groups).first()[0] == 1.0
    assert evaluate.optimal_threshold(evaluate.roc_points(groups)).first()["threshold"] == 0.9


def test_step_tables_are_cleared(spark):
    from ringfold.functions import lineage

    rows = lineage.written(spark.range(3))
    assert rows.count() == 3
    lineage.clear_steps(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(lineage.step_folder(spark))
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_blocks_of_a_large_group_are_few(spark):
    sizes = spark.createDataFrame([(1,), (50,), (2560,), (60000,), (1000000,)], "n long")
    got = [r[0] for r in sizes.select(patients.block_count(F.col("n"), 5)).collect()]
    assert got == [1, 10, 16, 16, 245]


def test_distance_sum_of_close_and_far_rows():
    rng = np.random.default_rng(5)
    low = np.concatenate([rng.random((30, 4)) + 1e6, rng.random((3, 4))])
    high = np.concatenate([low[:10], low[:10] + 1e-7, rng.random((300, 4))])

    def plain(a, b):
        return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))

    assert patients.distance_sum(low, high) == pytest.approx(plain(low, high).sum(), rel=1e-12)
    near = high[:20]
    assert patients.distance_sum(near) == pytest.approx(np.triu(plain(near, near)).sum(), rel=1e-6)
    assert patients.distance_sum(low[:5], low[:5] + 1e-7) == pytest.approx(plain(low[:5], low[:5] + 1e-7).sum(), rel=1e-9)
    assert patients.distance_sum(np.array([[np.inf, 0.0], [1.0, 2.0]])) == np.inf
    assert patients.distance_sum(low[:1]) == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_stats_are_never_broadcast_in_copies(spark, how):
    """Copies of the stats are not in the planner's estimate."""
    rows = spark.range(5000).select(F.col("id").alias("measurement_id"), (F.col("id") % 40).alias("k"))
    stats = spark.range(30).select(F.col("id").alias("k"), F.lit(1.0).alias("m"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("10m", "200", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            out = attach(rows, stats, ["k"], ["measurement_id"], how)
            assert out.columns == ["k", "measurement_id", "m"]
            assert out.count() == (5000 if how == "left" else 3750)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("Broadcast" in plan) == (limit == "10m")
            assert ("_salt" in plan) == (limit != "10m")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
