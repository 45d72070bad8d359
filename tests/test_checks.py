"""Measurement checks on small tables with planted defects."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import pixel_frame
from ringfold.operators import detector_checks, image, integrate, pattern_checks, signal_checks

ID = "measurement_id"
PERIOD = f"{ID} div 5"


def _exposures(n=30, size=6, seed=2):
    rng = np.random.default_rng(seed)
    images = {}
    for i in range(n):
        img = rng.uniform(80, 120, (size, size)) * (1 + i % 4)
        img[1, 2] = 0.0  # dead
        img[4, 4] *= 6  # hot
        img[i // 5, 5] *= 6  # moves from period to period
        images[i] = img
    return images


@pytest.mark.parametrize("skip_zero", [False, True])
def test_broken_pixels_persist_and_moving_ones_do_not(spark, skip_zero):
    px = pixel_frame(spark, _exposures(), skip_zero).repartition(3)
    told = detector_checks.pixel_persistence(px, F.expr(PERIOD), 6, 6, dead=0.2, hot=3.0)
    rows = {(r["row_idx"], r["col_idx"]): r for r in told.collect()}
    assert len(rows) == 36 and {r["n_periods"] for r in rows.values()} == {6}
    assert rows[0, 5]["n_hot"] == 1 and rows[3, 5]["n_hot"] == 1
    broken = detector_checks.broken_pixels(told, min_share=0.8)
    kinds = {(r["row_idx"], r["col_idx"]): r["kind"] for r in broken.collect()}
    assert kinds == {(1, 2): "dead", (4, 4): "hot"}
    # the result feeds the mask of the integration
    left = detector_checks.without_positions(px, broken)
    assert left.where("row_idx = 4 and col_idx = 4 or row_idx = 1 and col_idx = 2").count() == 0
    assert left.count() == px.count() - (30 if skip_zero else 60)
    assert detector_checks.broken_pixels(told, 0.8, min_periods=7).count() == 0


def test_sketches_merge_and_give_quantiles(spark):
    px = pixel_frame(spark, _exposures())
    whole = detector_checks.pixel_sketch(px, F.lit(0))
    parts = [detector_checks.pixel_sketch(px.where(f"{ID} % 3 = {k}"), F.lit(0)) for k in range(3)]
    joined = detector_checks.merged(parts[0].union(parts[1]).union(parts[2]), "row_idx", "col_idx", "period")
    assert sorted(joined.collect()) == sorted(whole.select(joined.columns).collect())
    got = detector_checks.quantile(whole, ["row_idx", "col_idx"], 0.5, "mid").collect()
    images = _exposures()
    for r in got:
        values = sorted(img[r["row_idx"], r["col_idx"]] / img.mean() for img in images.values())
        assert r["mid"] == pytest.approx(values[14], rel=0.011)


def test_cosmic_rays_are_short(spark):
    rng = np.random.default_rng(3)
    img = rng.normal(100, 2, (20, 20))
    img[:, 15] += 300  # a line of the pattern
    clean = img.copy()
    img[4, 4] = 900
    img[9, 8], img[10, 9] = 500, 450  # a streak on a diagonal
    img[0, 0] = 700  # a corner
    cells = [(1, img.tolist()), (2, None), (3, []), (4, [[1.0, 2.0], [3.0]]), (5, [[7.0]]), (6, clean.tolist())]
    df = spark.createDataFrame(cells, f"{ID} long, measurement_data array<array<double>>")
    found = detector_checks.cosmic_rays(df, factor=10, least=2.0, max_run=3)
    rows = {r[ID]: r["rays"] for r in found.collect()}
    at = {(r["row_idx"], r["col_idx"]): r["run"] for r in rows[1]}
    assert at == {(4, 4): 1, (9, 8): 2, (10, 9): 2, (0, 0): 1}
    assert rows[2] is None and rows[3] is None and rows[4] is None
    assert rows[5] == [] and rows[6] == []
    out = {r[ID]: r["measurement_data"] for r in detector_checks.without_rays(found).collect()}
    assert np.abs(np.array(out[1]) - clean).max() < 15 and out[6] == clean.tolist()
    assert out[2] is None and out[4] == [[1.0, 2.0], [3.0]]


def test_run_lengths_go_straight():
    at = [(0, 0), (0, 1), (0, 2), (0, 4), (1, 1), (2, 0), (5, 5), (6, 6), (7, 7), (8, 8)]
    rows, cols = (np.array(x) for x in zip(*at))
    assert detector_checks.run_lengths(rows, cols).tolist() == [3, 3, 3, 1, 3, 3, 4, 4, 4, 4]
    assert detector_checks.run_lengths(rows[:0], cols[:0]).tolist() == []


def _ring(spark, value, keep=lambda chi: True):
    rows = []
    for i, chi in enumerate(np.linspace(-180, 180, 400, endpoint=False)):
        if keep(chi):
            rows.append((1, 0, i, float(value(np.radians(chi))), float(chi), 1.0 + 1e-4 * i, 1.0, 1.1))
    return spark.createDataFrame(
        rows, f"{ID} long, row_idx int, col_idx int, value double, chi double, q double, q_lo double, q_hi double"
    )


def test_harmonics_with_uneven_coverage(spark):
    def value(a):
        return 50 * (1 + 0.2 * np.cos(a - 0.5) + 0.1 * np.cos(2 * a + 1))

    geo = _ring(spark, value, lambda chi: -120 < chi < 100)
    row = pattern_checks.ring_harmonics(geo, 1, 2).first()
    assert row["mean"] == pytest.approx(50)
    assert (row["index_1"], row["index_2"]) == (pytest.approx(0.2), pytest.approx(0.1))
    assert (row["phase_1"], row["phase_2"]) == (pytest.approx(0.5), pytest.approx(-1))
    flat = pattern_checks.asymmetry(pattern_checks.ring_harmonics(_ring(spark, lambda a: 7.0), 4, 2)).first()
    assert flat["index_1"] == pytest.approx(0, abs=1e-9)
    # too narrow a sector cannot tell the functions apart
    narrow = pattern_checks.ring_harmonics(_ring(spark, value, lambda chi: 0 < chi < 8), 1, 2)
    assert narrow.first()["index_1"] is None
    assert pattern_checks.asymmetry(narrow).first()["index_2"] is None


def test_harmonics_with_weights(spark):
    geo = _ring(spark, lambda a: 10 + (5 if abs(a - 1) < 0.2 else 0))
    whole = pattern_checks.ring_harmonics(geo, 1, 1, weight=F.lit(3.0)).first()
    plain = pattern_checks.ring_harmonics(geo, 1, 1).first()
    assert whole["index_1"] == pytest.approx(plain["index_1"])
    without = pattern_checks.ring_harmonics(geo, 1, 1, weight=F.when(F.col("value") > 12, 0.0).otherwise(1.0)).first()
    assert without["index_1"] == pytest.approx(0, abs=1e-9) and without["mean"] == pytest.approx(10)


def test_center_shapes(spark):
    y, x = np.mgrid[:61, :61] - 30.0
    turned = (x * math.cos(0.5) + y * math.sin(0.5)) / 20, (y * math.cos(0.5) - x * math.sin(0.5)) / 10
    disc, ellipse = x**2 + y**2 <= 400, turned[0] ** 2 + turned[1] ** 2 <= 1
    hollow = disc & (x**2 + y**2 >= 200)
    images = {1: disc * 9.0, 2: ellipse * 9.0, 3: hollow * 9.0, 4: np.ones((61, 61))}
    images[2][0, 0] = 9.0  # a smaller region
    rows = {r[ID]: r for r in pattern_checks.center_shape(pixel_frame(spark, images), 1.5).collect()}
    assert rows[1]["roundness"] == pytest.approx(1, abs=1e-6) and rows[1]["fill"] == pytest.approx(1, abs=0.01)
    assert rows[1]["area"] == disc.sum() and rows[1]["major"] == pytest.approx(20, rel=0.01)
    assert rows[2]["roundness"] == pytest.approx(0.5, abs=0.01) and rows[2]["angle"] == pytest.approx(math.degrees(0.5), abs=1)
    assert (rows[2]["center_row"], rows[2]["center_col"]) == (pytest.approx(30), pytest.approx(30))
    assert rows[3]["fill"] < 0.5 and rows[4]["area"] is None


def test_regions_of_runs_equal_flood_fill(spark):
    rng = np.random.default_rng(8)
    images = {i: (rng.random((24, 24)) < p) * 1.0 for i, p in enumerate((0.2, 0.4, 0.5, 0.6, 1.0))}
    lit = pixel_frame(spark, images, skip_zero=True)
    got = {(r[0], r[1]): r[2] for r in image.label_regions(lit.union(lit)).select(ID, "node", "label").collect()}
    for i, img in images.items():
        seen = {}
        for start in zip(*np.nonzero(img)):
            todo, label = [start], int(start[0]) * image.LINE + int(start[1])
            while todo:
                r, c = todo.pop()
                if not (0 <= r < 24 and 0 <= c < 24) or not img[r, c] or (r, c) in seen:
                    continue
                seen[r, c] = label
                todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert {k: v for (m, k), v in got.items() if m == i} == {
            int(r) * image.LINE + int(c): v for (r, c), v in seen.items()
        }


def _prominences(y):
    out = {}
    for i in range(1, len(y) - 1):
        k = i
        while k < len(y) - 1 and y[k + 1] == y[i]:
            k += 1
        if y[i - 1] >= y[i] or k == len(y) - 1 or y[k + 1] > y[i]:
            continue
        left = next((j for j in range(i - 1, -1, -1) if y[j] >= y[i]), None)
        right = next((j for j in range(i + 1, len(y)) if y[j] > y[i]), None)
        saddles = [min(y[left:i])] if left is not None else []
        saddles += [min(y[i:right])] if right is not None else []
        out[i] = y[i] - max(saddles, default=min(y))
    return {k: v for k, v in out.items() if v > 0}


def test_prominences_equal_their_definition():
    rng = random.Random(6)
    for _ in range(400):
        y = [float(rng.randrange(rng.choice([3, 9, 1000]))) for _ in range(rng.randrange(0, 40))]
        at, rise = signal_checks.prominences(np.array(y))
        assert dict(zip(at.tolist(), rise.tolist())) == _prominences(y)


def test_peaks_that_shift(spark):
    q = [0.5 + 0.05 * i for i in range(100)]

    def curve(scale, second=1.0):
        return [3 * math.exp(-(((x - 2 * scale) / 0.2) ** 2)) + second * math.exp(-(((x - 4) / 0.2) ** 2)) for x in q]

    rows = [
        (5, "c", q, curve(1.0)), (6, "c", q, curve(1.005)), (7, "c", q, curve(1.03)), (8, "c", q, curve(1.0, 0.0)),
        (9, "d", q, curve(1.03)), (10, None, q, curve(1.0)), (11, "c", q, None), (2, "c", q, [1.0] * 100),
        (12, "c", q, [float("nan")] * 100), (13, "d", [], []),
    ]
    df = spark.createDataFrame(rows, f"{ID} long, cal string, q_range array<double>, radial_profile_data array<double>")
    found = signal_checks.peaks(df, 0.1)
    sizes = {r[ID]: r["n"] for r in found.select(ID, F.size("peaks").alias("n")).collect()}
    assert sizes[5] == 2 and sizes[8] == 1 and sizes[2] == 0 and sizes[13] == 0 and sizes[11] is None and sizes[12] is None
    got = {(r[ID], r["peak"]): r for r in signal_checks.peak_consistency(found, "cal", window=0.05).collect()}
    assert {r["reference_id"] for (m, _), r in got.items() if m < 9} == {5}
    assert got[5, 0]["q_reference"] == pytest.approx(2, abs=1e-3) and got[6, 0]["shift"] == pytest.approx(0.005, abs=1e-3)
    told = {k: r["consistent"] for k, r in got.items()}
    assert told[5, 0] and told[6, 0] and told[6, 1] and not told[7, 0] and told[7, 1]
    assert not told[8, 1] and got[8, 1]["q_found"] is None  # the peak is gone
    assert told[9, 0] and got[9, 0]["reference_id"] == 9
    assert not any(m in (10, 11, 12) for m, _ in told) and not told[2, 0]


def test_stability_finds_a_drift_in_blocks(spark):
    rng = random.Random(7)
    steady = [rng.gauss(100, 5) for _ in range(200)]
    drift = [rng.gauss(100, 5) + (0 if i < 120 else 12) for i in range(200)]
    rows = [(s, 3 * i, v) for s, values in (("a", steady), ("b", drift)) for i, v in enumerate(values)]
    rows += [("c", i, 5.0) for i in range(4)] + [("d", 0, None), ("d", 1, float("nan"))]
    df = spark.createDataFrame(rows, f"series string, {ID} long, intensity double").repartition(4)
    for block in (1, 50, 4096):
        out = signal_checks.intensity_stability(df, ["series"], 0.5, 8.0, block=block).collect()
        got = {(r["series"], r[ID]): r for r in out}
        assert len(got) == 404
        for name, values in (("a", steady), ("b", drift)):
            mean, std, high, low = np.mean(values), np.std(values), 0.0, 0.0
            for i, v in enumerate(values):
                z = (v - mean) / std
                high, low = max(0, high + z - 0.5), max(0, low - z - 0.5)
                row = got[name, 3 * i]
                assert (row["high"], row["low"]) == (pytest.approx(high, abs=1e-9), pytest.approx(low, abs=1e-9))
        assert all(got["a", 3 * i]["stable"] for i in range(200))
        assert not got["b", 3 * 199]["stable"] and not all(got["b", 3 * i]["stable"] for i in range(121))
        assert all(got["c", i]["stable"] for i in range(4))


def test_noise_signal_and_structure(spark):
    rng = random.Random(9)
    noise = [5 + rng.gauss(0, 0.5) for _ in range(400)]
    peak = [n + 20 * math.exp(-(((i - 200) / 40) ** 2)) for i, n in enumerate(noise)]
    slope = [n + 0.05 * i for i, n in enumerate(noise)]
    rows = [(1, noise), (2, peak), (3, slope), (4, [1.0] * 9), (5, [1.0, 2.0]), (6, [1.0, None, 2.0, 3.0]), (7, None), (8, [])]
    df = spark.createDataFrame(rows, f"{ID} long, radial_profile_data array<double>")
    found = signal_checks.signal_quality(df)
    got = {r[ID]: r for r in found.collect()}
    for i in (1, 2, 3):
        assert got[i]["noise"] == pytest.approx(0.5, rel=0.2)
    assert got[2]["snr"] > 30 and got[1]["snr"] < 5
    assert abs(got[1]["runs_z"]) < 3 and got[2]["runs_z"] < -10 and got[3]["runs_z"] < -10
    assert (got[4]["noise"], got[4]["snr"], got[4]["runs_z"]) == (0.0, None, None)
    assert all(got[i]["level"] is None and got[i]["noise"] is None for i in (5, 6, 7, 8))

    def passed(kind):
        return {r[ID]: r["passed"] for r in signal_checks.quality_verdict(found, F.lit(kind), 10, 1.5, 3).collect()}

    assert passed("tissue")[2] and not passed("tissue")[1] and passed("tissue")[7] is None
    assert passed("empty")[1] and not passed("empty")[2]
    assert not passed("dark")[1] and passed("dark")[4] and passed("other")[1] is None


def test_masks_agree_with_lists(spark):
    px = pixel_frame(spark, _exposures(3))
    listed = spark.createDataFrame([(1, 2), (4, 4)], "row_idx int, col_idx int")
    a = integrate.mask_pixels(px, [(1, 2), (4, 4)]).orderBy(ID, "row_idx", "col_idx").collect()
    b = detector_checks.without_positions(px, listed).select(px.columns).orderBy(ID, "row_idx", "col_idx").collect()
    assert [tuple(r[c] for c in px.columns) for r in a] == [tuple(r) for r in b]
