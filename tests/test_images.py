import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import geometry, pixel_frame, q_grid
from ringfold.operators import calibration, deviation, image, integrate
from ringfold.plans import images as plans

N = 16


def test_constant_image_is_flat(spark):
    out = integrate.integrate_1d(geometry(spark, {1: np.full((N, N), 7.0)}, N), 8).collect()
    assert sum(r["n_pixels"] for r in out) == N * N
    assert all(r["intensity"] == 7 and r["std"] == 0 and r["sem"] == 0 for r in out)


def test_ring_lights_one_bin(spark):
    q, _ = q_grid(N)
    at = np.minimum(((q - q.min()) / (q.max() - q.min()) * 8).astype(int), 7)
    out = integrate.integrate_1d(geometry(spark, {1: (at == 3) * 5.0}, N), 8).collect()
    assert {r["pos"]: r["intensity"] for r in out if r["intensity"]} == {3: 5.0}


def test_cake_weighted_by_count_is_the_profile(spark):
    rng = np.random.default_rng(0)
    geo = geometry(spark, {1: rng.random((N, N))}, N)
    binned = integrate.with_chi_bin(integrate.with_q_bin(geo, 6), 9)
    counts = binned.groupBy("chi_bin", "pos").count()
    cake = integrate.integrate_2d(geo, 6, 9).join(counts, ["chi_bin", "pos"])
    merged = cake.groupBy("pos").agg(
        (F.sum(F.col("intensity") * F.col("count")) / F.sum("count")).alias("v")
    )
    want = {r["pos"]: r["intensity"] for r in integrate.integrate_1d(geo, 6).collect()}
    got = {r["pos"]: r["v"] for r in merged.collect()}
    assert got == pytest.approx(want)


def test_sigma_clip_drops_the_hot_pixel(spark):
    img = np.ones((N, N)) * 2.0
    img[4, 4] = 1000.0
    img[4, 5] = 2.5
    geo = geometry(spark, {1: img}, N)
    clipped = integrate.sigma_clip(geo, 1, thres=3.0, max_iter=5).first()
    assert clipped["n_pixels"] == N * N - 2 and clipped["intensity"] == 2.0
    kept = integrate.sigma_clip(geo, 1, thres=3.0, max_iter=0).first()
    assert kept["n_pixels"] == N * N
    once = integrate.sigma_clip(geo, 1, thres=3.0, max_iter=1).first()
    assert once["n_pixels"] == N * N - 1


def test_angular_ranges(spark):
    ranges = spark.createDataFrame(
        [(170.0, -170.0), (-180.0, 180.0), (-90.0, 0.0)], "range_start double, range_end double"
    )
    rows = integrate.split_ranges(ranges).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["range_start"], []).append((r["lo"], r["hi"], r["weight"]))
    assert sorted(parts[170]) == [(-180, -170, 0.5), (170, 180, 0.5)]
    assert sorted(parts[-180]) == [(-180, -180, 0), (-180, 180, 1)]
    assert parts[-90] == [(-90, 0, 1)]
    with pytest.raises(ValueError):
        integrate.rotating_angles(
            geometry(spark, {1: np.ones((4, 4))}, 4), [(-181, 0)], 4
        )
    bad = spark.createDataFrame([(-181.0, 0.0)], "range_start double, range_end double")
    with pytest.raises(Exception, match="within -180 and 180"):
        integrate.split_ranges(bad).collect()


def test_whole_circle_equals_the_profile(spark):
    rng = np.random.default_rng(5)
    geo = geometry(spark, {1: rng.random((N, N))}, N)
    plain = {r["pos"]: r["intensity"] for r in integrate.integrate_1d(geo, 5).collect()}
    turned = integrate.rotating_angles(geo, [(-180, 180)], 5).collect()
    assert {r["pos"]: r["intensity"] for r in turned} == pytest.approx(plain)


def test_mask_and_product(spark):
    px = pixel_frame(spark, {1: np.arange(9.0).reshape(3, 3)})
    assert integrate.mask_pixels(px, []).count() == 9
    assert integrate.mask_pixels(px, [(0, 0), (1, 1)]).count() == 7
    mask = spark.createDataFrame([(2, 2, 1), (1, 1, 0)], "row_idx int, col_idx int, m int")
    got = {(r["row_idx"], r["col_idx"]): r["value"] for r in image.mask_product(px, mask).collect()}
    assert got == {(2, 2): 8.0, (1, 1): 0.0}


def test_pixels_of_one_calibration_are_spread(spark):
    px = pixel_frame(spark, {i: np.ones((N, N)) for i in range(4)}).withColumn("cal_id", F.lit(1))
    cal = spark.createDataFrame([(1, 0.1), (2, 0.2)], "cal_id int, distance_m double")
    mask = spark.createDataFrame([(2, 2, 3), (1, 1, 0)], "row_idx int, col_idx int, m int")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ["-1", "false"]):
            spark.conf.set(n, v)
        both = calibration.attach_calibration(px, cal).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in both.groupBy("part").count().collect()]
        assert sum(sizes) == 4 * N * N and len(sizes) > 1
        assert both.where("distance_m <> 0.1").count() == 0
        assert image.mask_product(px, mask).groupBy().sum("value").first()[0] == 12.0
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_beam_center_examples(spark):
    hot = np.zeros((10, 10))
    hot[5, 5] = 10
    blobs = np.zeros((10, 10))
    for r, c in [(1, 1), (2, 2), (3, 3), (7, 7), (7, 8)]:
        blobs[r, c] = 5
    tie = np.zeros((10, 10))
    tie[2, 2] = tie[8, 8] = 5
    snake = np.zeros((20, 20))
    for k in range(0, 20, 2):
        snake[k, :] = 5
        if k + 1 < 20:
            snake[k + 1, 19 if k % 4 == 0 else 0] = 5
    px = pixel_frame(
        spark, {1: hot, 2: np.zeros((10, 10)), 3: blobs, 4: tie, 5: snake}
    )
    got = {r["measurement_id"]: r for r in image.beam_center(px, 0.5).collect()}
    center = {i: (r["center_row"], r["center_col"]) for i, r in got.items()}
    assert center[1] == (5.0, 5.0)
    assert center[2] == (None, None)
    assert center[3] == (2.0, 2.0) and got[3]["area"] == 3
    assert center[4] == (2.0, 2.0)
    assert got[5]["area"] == int((snake > 0).sum())


def test_deviation_against_numpy(spark):
    rng = np.random.default_rng(7)
    img = rng.integers(0, 20, (N, N)).astype(float)
    geo = geometry(spark, {1: img}, N)
    q, _ = q_grid(N)
    step = (q.max() - q.min()) / 6
    centers = q.min() + (np.arange(6) + 0.5) * step
    digit = np.digitize(q, centers)
    out = deviation.deviation(geo, [1.3], [0.7], 6).collect()
    got = {(r["side"], r["digit"]): r["deviation"] for r in out}
    for d in np.unique(digit):
        ring = img[digit == d]
        high = ring[ring > ring.mean() * 1.3]
        low = ring[(ring < ring.mean() * 0.7) & (ring != 0)]
        assert got[("above", d)] == (pytest.approx(high.mean()) if high.size else None)
        assert got[("below", d)] == (pytest.approx(low.mean()) if low.size else None)


def test_one_measurement_with_a_third_of_all_rows(spark):
    """A key far larger than the others, in every join that returns to pixels."""
    rng = np.random.default_rng(8)
    big = rng.integers(0, 9, (48, 48)).astype(float)
    images = {0: big} | {i: rng.integers(0, 9, (8, 8)).astype(float) for i in range(1, 40)}
    px = pixel_frame(spark, images)
    norms = {r[0]: r[1] for r in px.groupBy("measurement_id").sum("value").collect()}
    bright = image.bright_pixels(px, 1.0).groupBy("measurement_id").count().collect()
    for r in bright:
        img = images[r["measurement_id"]]
        assert r["count"] == int((img > img.mean()).sum())
    assert norms[0] == big.sum()


def test_spark_entry_plan_has_no_cross_join_and_prunes(spark):
    df = plans.integrate_1d(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_extendedprice" not in plan


def test_tilted_range_covers_all_pixels(spark):
    """The q range from a few places equals that of all pixels."""
    cal = spark.createDataFrame(
        [(1, 0.16, 0.0011, 0.0009, 0.00015, 0.00015, 0.1542, 0.05, -0.03, 0.4), (2, 0.16, 0.0, 0.0, 0.00015, 0.00015, 0.1542, 0.0, 0.0, 0.0)],
        "cal_id int, distance_m double, poni1 double, poni2 double, pixel1 double, pixel2 double,"
        "wavelength_nm double, rot1 double, rot2 double, rot3 double",
    )
    shifted = cal.withColumns(
        {"poni1": F.col("poni1") - 0.16 * F.tan("rot2"), "poni2": F.col("poni2") + 0.16 * F.tan("rot1")}
    )
    grid = spark.range(16 * 16).select(
        (F.col("id") / 16).cast("int").alias("row_idx"), (F.col("id") % 16).cast("int").alias("col_idx")
    )
    from ringfold.operators import calibration

    ranges = {r["cal_id"]: r for r in calibration.full_q_range(shifted, 16, 16).collect()}
    pixels = calibration.with_geometry(grid.crossJoin(shifted))
    for r in pixels.groupBy("cal_id").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).collect():
        assert abs(ranges[r["cal_id"]]["q_lo"] - r["lo"]) < 1e-9
        assert abs(ranges[r["cal_id"]]["q_hi"] - r["hi"]) < 1e-9


def test_tilted_range_of_a_detector_beside_the_beam(spark):
    """Its smallest q is on an edge, away from the pixels nearest to the beam."""
    import random

    from ringfold.operators import calibration

    rng = random.Random(4)
    cal = spark.createDataFrame(
        [
            (k, 0.16, rng.uniform(-0.02, 0.04), rng.uniform(-0.02, 0.04), 0.0004, 0.0003, 0.1542, *[rng.uniform(-0.6, 0.6) for _ in range(3)])
            for k in range(60)
        ],
        "cal_id int, distance_m double, poni1 double, poni2 double, pixel1 double, pixel2 double,"
        "wavelength_nm double, rot1 double, rot2 double, rot3 double",
    )
    grid = spark.range(48 * 40).select(
        (F.col("id") / 40).cast("int").alias("row_idx"), (F.col("id") % 40).cast("int").alias("col_idx")
    )
    ranges = {r["cal_id"]: r for r in calibration.full_q_range(cal, 48, 40).collect()}
    pixels = calibration.with_geometry(grid.crossJoin(cal)).groupBy("cal_id")
    wrong = [
        r["cal_id"]
        for r in pixels.agg(F.min("q").alias("lo"), F.max("q").alias("hi")).collect()
        if abs(ranges[r["cal_id"]]["q_lo"] - r["lo"]) > 1e-9 or abs(ranges[r["cal_id"]]["q_hi"] - r["hi"]) > 1e-9
    ]
    assert not wrong, f"{len(wrong)} of 60"


def test_solid_angle_does_not_depend_on_tilts(spark):
    """Distance over the pixel's own distance, cubed, whatever the rotation."""
    from ringfold.operators import integrate

    row = spark.range(1).select(
        F.lit(255).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit(0.1).alias("pixel1"), F.lit(0.1).alias("pixel2"),
        F.lit(12.8).alias("poni1"), F.lit(12.8).alias("poni2"), F.lit(50.0).alias("distance_m"), F.lit(0.4).alias("rot1"),
    )
    want = (50 / np.sqrt(50**2 + 2 * 12.75**2)) ** 3
    assert row.select(integrate.solid_angle()).first()[0] == pytest.approx(want)


def test_resize_with_many_calibrations_of_few_sizes(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 900, (6, 5))
    cells = [(m, m, i, j, float(values[i, j])) for m in (0, 1, 2) for i in range(6) for j in range(5)]
    pixels = spark.createDataFrame(cells, "measurement_id long, cal_id long, row_idx int, col_idx int, value double")
    # calibration 1 is given twice; none of the others beyond 1 has pixels
    given = [(0, 0.2), (1, 0.1), (1, 0.1), (2, None), (3, 1e9)] + [(i, 0.1 + i * 1e-9) for i in range(4, 300)]
    calibrations = spark.createDataFrame(given, "cal_id long, distance_m double")

    def matrix(n, size):
        out = np.zeros((size, n))
        for o in range(size):
            at = (o + 0.5) * n / size - 0.5
            for tap in (-1, 0, 1, 2):
                i = int(np.floor(at)) + tap
                t = abs(at - i)
                w = (1.25 * t - 2.25) * t * t + 1 if t <= 1 else ((-0.75 * t + 3.75) * t - 6) * t + 3 if t < 2 else 0
                out[o, min(max(i, 0), n - 1)] += w
        return out

    got = {}
    out = image.image_resize(pixels, calibrations, 100.0, 6, 5)
    for r in out.collect():
        got.setdefault(r["measurement_id"], {})[r["row_idx"], r["col_idx"]] = r["value"]
    assert sorted(got) == [0, 1]
    for m, (rows, cols, times) in {0: (3, 2, 1), 1: (6, 5, 4)}.items():
        want = matrix(6, rows) @ values @ matrix(5, cols).T * times
        want = np.clip(np.round(np.round(want, 9)), 0, 65535)
        assert got[m] == {(i, j): want[i, j] for i in range(rows) for j in range(cols)}
    sizes = spark.createDataFrame([(3,), (6,)], "row_size int")
    assert image.resize_weights(sizes, 6, "row").count() <= 4 * (3 + 6)
