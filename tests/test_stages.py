import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from helpers import CALIBRATION, TEXT, q_grid
from ringfold.ml import models, stages
from ringfold.operators import terms

N = 16


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [
        (i, rng.integers(1, 50, (N, N)).astype(float).tolist(), TEXT, 10.0)
        for i in range(3)
    ] + [(9, np.ones((N, N)).tolist(), None, 10.0)]
    return spark.createDataFrame(
        rows,
        "measurement_id long, measurement_data array<array<double>>, "
        "ponifile string, thickness double",
    )


def image_of(table, i):
    row = table.filter(F.col("measurement_id") == i).first()
    return np.array(row["measurement_data"])


def test_integration_1d_matches_numpy(table):
    out = stages.AzimuthalIntegration(npt=12, calibration_mode="poni").transform(table)
    assert out.count() == 3
    row = out.filter("measurement_id = 1").first()
    q, _ = q_grid(N)
    image = image_of(table, 1)
    edges = np.linspace(q.min(), q.max(), 13)
    at = np.minimum(((q - q.min()) / (q.max() - q.min()) * 12).astype(int), 11)
    for b in range(12):
        values = image[at == b]
        assert row["radial_profile_data"][b] == pytest.approx(values.mean() if values.size else 0)
        assert row["radial_std"][b] == pytest.approx(values.std() if values.size else 0)
        assert row["q_range"][b] == pytest.approx((edges[b] + edges[b + 1]) / 2)
    assert row["calculated_distance"] == pytest.approx(0.16)
    assert row["center_x"] == pytest.approx(CALIBRATION["poni2"] / CALIBRATION["pixel2"])
    assert "measurement_data" not in out.columns


def test_integration_modes_give_their_columns(table):
    cake = stages.AzimuthalIntegration(
        npt=8, npt_azim=6, mode="2D", calibration_mode="poni", calc_cake_stats=True
    ).transform(table)
    row = cake.filter("measurement_id = 0").first()
    assert np.array(row["radial_profile_data"]).shape == (6, 8)
    assert len(row["q_range"]) == 8 and len(row["azimuthal_positions"]) == 6
    column = np.array(row["radial_profile_data"])[:, 5]
    lit = column[column != 0]
    assert row["cake_col_mean"][5] == pytest.approx(lit.mean())
    assert row["cake_col_variance"][5] == pytest.approx(lit.var())
    clipped = stages.AzimuthalIntegration(
        npt=8, mode="sigma_clip", calibration_mode="poni", thres=1.5
    ).transform(table)
    assert len(clipped.first()["radial_profile_data"]) == 8
    turned = stages.AzimuthalIntegration(
        npt=8,
        mode="rotating_angles",
        calibration_mode="poni",
        angles=[[-90, 0], [170, -170]],
        keep_image=True,
    ).transform(table)
    names = set(turned.columns)
    for label in ("-90_0", "170_-170"):
        for kind in ("q_range", "radial_profile_data", "sigma", "std"):
            assert f"{kind}_{label}" in names
    assert "measurement_data" in names
    with pytest.raises(ValueError):
        stages.AzimuthalIntegration(mode="3D", calibration_mode="poni").transform(table)


def test_integration_from_columns_and_ranges(spark, table):
    cal = CALIBRATION
    rows = table.withColumns(
        {
            "pixel_size": F.lit(150.0),
            "center": F.struct(
                F.lit(cal["poni1"] / cal["pixel1"]).alias("row"),
                F.lit(cal["poni2"] / cal["pixel2"]).alias("col"),
            ),
            "calculated_distance": F.lit(0.16),
            "wavelength": F.lit(0.1542),
            "interpolation_q_range": F.struct(
                F.lit(0.1).alias("q_min"), F.lit(0.4).alias("q_max")
            ),
            "azimuthal_range": F.struct(
                F.lit(-150.0).alias("start"), F.lit(-120.0).alias("end")
            ),
        }
    )
    out = stages.AzimuthalIntegration(npt=6).transform(rows)
    row = out.filter("measurement_id = 2").first()
    q, chi = q_grid(N)
    keep = (q >= 0.1) & (q <= 0.4) & (chi >= -150) & (chi <= -120)
    at = np.minimum(((q - 0.1) / 0.3 * 6).astype(int), 5)
    image = image_of(table, 2)
    for b in range(6):
        values = image[keep & (at == b)]
        assert row["radial_profile_data"][b] == pytest.approx(values.mean() if values.size else 0)


def test_faulty_pixels_are_left_out(table):
    plain = stages.AzimuthalIntegration(npt=4, calibration_mode="poni")
    masked = stages.AzimuthalIntegration(
        npt=4, calibration_mode="poni", faulty_pixels=[[0, 0], [3, 5]]
    )
    a = plain.transform(table).filter("measurement_id = 0").first()
    b = masked.transform(table).filter("measurement_id = 0").first()
    assert a["radial_profile_data"] != b["radial_profile_data"]


@pytest.mark.parametrize("mode", ["cake", "ring"])
def test_deviation_columns(table, mode):
    out = stages.DeviationTransformer(
        npt=6, mode=mode, shape=[N, N], npt_azim=8, above_limits=[1.2], below_limits=[0.8]
    ).transform(table)
    row = out.filter("measurement_id = 0").first()
    assert np.array(row["image_above_1.2"]).shape == (N, N)
    assert len(row["deviation_below_0.8"]) == (6 if mode == "cake" else 7)
    assert ("cake_above_1.2" in out.columns) == (mode == "cake")


def test_cut_resize_and_crop(table):
    ready = table.filter("ponifile is not null")
    cut = stages.MeasurementCutter(
        column="measurement_data", distances=[[None, 3.0]]
    ).transform(table)
    assert cut.count() == 3
    center = (CALIBRATION["poni1"] / 0.00015, CALIBRATION["poni2"] / 0.00015)
    r, c = np.mgrid[:N, :N]
    far = np.sqrt((c - center[1]) ** 2 + (r - center[0]) ** 2) > 3
    image = image_of(table, 0)
    got = np.array(cut.filter("measurement_id = 0").first()["measurement_data"])
    assert np.array_equal(got, image * far)
    same = stages.ImageResizer(
        column="measurement_data", ref_distance=160.0, shape=[N, N]
    ).transform(ready)
    row = same.filter("measurement_id = 0").first()
    assert np.array_equal(np.array(row["measurement_data"]), image)
    half = stages.ImageResizer(
        column="measurement_data", ref_distance=80.0, shape=[N, N]
    ).transform(ready)
    row = half.filter("measurement_id = 0").first()
    assert np.array(row["measurement_data"]).shape == (N // 2, N // 2)
    assert "Poni1:0.001205" in row["ponifile"]
    crop = stages.CommonRegionCutter(
        column="measurement_data", square=True, shape=[N, N]
    ).transform(ready)
    shape = np.array(crop.first()["measurement_data"]).shape
    assert shape[0] < N or shape[1] < N


def test_fourier_2d_matches_numpy(table):
    out = stages.FourierTransform(
        fourier_mode="2D", columns=["measurement_data"], shape=[N, N]
    ).transform(table)
    row = out.filter("measurement_id = 2").first()
    image = image_of(table, 2)
    want = np.fft.fftshift(np.fft.fft2(image))
    assert np.allclose(row["fft2_real"], want.real)
    assert np.allclose(row["fft2_imag"], want.imag)
    assert np.allclose(row["fft2_shifted"]["im"], want.imag)
    assert np.allclose(row["fft2_norm_magnitude"], np.abs(want) / image.sum())
    assert np.allclose(row["fft2_reconstructed"], image)
    assert np.allclose(row["fft2_vertical_profile"], (np.abs(want) / image.sum())[:, N // 2])
    assert np.allclose(row["fft2_freq_vertical"], np.fft.fftshift(np.fft.fftfreq(N)))
    one = stages.FourierTransform(
        fourier_mode="2D",
        columns=["measurement_data"],
        shape=[N, N],
        features="fft2_phase",
        remove_beam="real",
        thresh=48.0,
    ).transform(table)
    assert [c for c in one.columns if c.startswith("fft2")] == ["fft2_phase"]


def test_fourier_1d_cells(spark):
    rng = np.random.default_rng(0)
    curve = rng.random(33)
    df = spark.createDataFrame([(1, curve.tolist())], "measurement_id long, y array<double>")
    row = stages.FourierTransform(order=4, columns=["y"]).transform(df).first()
    want = np.fft.fft(curve)
    assert np.allclose(
        row["fourier_coefficients_y"],
        np.concatenate([want[1:5].real, want[1:5].imag]),
    )
    want[5:-4] = 0
    assert np.allclose(row["fourier_inverse_y"], np.fft.ifft(want).real)


def test_hankel_and_goodness_stages(spark):
    rng = np.random.default_rng(2)
    cake = rng.random((6, 10)) + 1
    df = spark.createDataFrame(
        [(1, cake.tolist(), np.linspace(0.1, 1.0, 10).tolist())],
        "measurement_id long, radial_profile_data array<array<double>>, q_range array<double>",
    )
    h = stages.HankelTransformer(
        column="radial_profile_data", start_radius=2, shape=[6, 10]
    ).transform(df)
    assert np.array(h.first()["hankel"]).shape == (6, 8)
    g = stages.GoodnessAnalysisTransformer(
        column="radial_profile_data", shape=[6, 10]
    ).transform(df)
    dev = (cake - cake.mean(axis=0)) / cake.mean(axis=0) * 100
    power = np.abs(np.fft.fft2(dev - dev.mean())) ** 2
    fa, fq = np.meshgrid(np.fft.fftfreq(6), np.fft.fftfreq(10), indexing="ij")
    want = power[np.sqrt(fq**2 + fa**2) > 0.25].sum() / power.sum() * 100
    assert g.first()["goodness"] == pytest.approx(want)
    with pytest.raises(ValueError):
        stages.GoodnessAnalysisTransformer(column="missing").transform(df)


def test_normalizers_and_extractor(spark):
    df = spark.createDataFrame(
        [(1, 2.0, [3.0, -4.0], [[1.0, 2.0], [3.0, 4.0]])],
        "measurement_id long, a double, b array<double>, c array<array<double>>",
    )
    n = stages.ColumnNormalizer
    assert n(column="b", norm="l2").transform(df).first()["b"] == [0.6, -0.8]
    assert n(column="b", norm="max").transform(df).first()["b"] == [0.75, -1.0]
    assert n(column="c", norm="l1", mode="2D").transform(df).first()["c"] == [
        [0.1, 0.2],
        [0.3, 0.4],
    ]
    got = stages.ColumnExtractor(columns=["a", "b", "c"]).transform(df).first()
    assert got["features"].toArray().tolist() == [2, 3, -4, 1, 2, 3, 4]


def test_curve_fitting_stage(spark):
    x = np.round(np.arange(40) * 0.1, 10)
    y = 2 * np.exp(-((x - 2.0) ** 2) / (2 * 0.5**2)) + 0.25
    df = spark.createDataFrame(
        [(1, x.tolist(), y.tolist())], "measurement_id long, x array<double>, y array<double>"
    )
    p = terms.Parameter
    model = terms.TermSum(
        (
            terms.GaussianPeak(p(1, 0, 5), p(2.2, 1, 3), p(0.6, 0.1, 0.9)),
            terms.ConstantBackground(p(0, -1, 1)),
        )
    )
    stage = stages.CurveFitting.of("x", "y", model, grid=9, rounds=3)
    row = stage.transform(df).first()
    assert np.allclose(row["fit_params_all"], [2, 2, 0.5, 0.25], atol=1e-6)
    assert row["fit_params_1"] == pytest.approx([0.25])
    assert np.allclose(row["fitted_curve"], y)
    assert row["fit_cond"] > 1


def small_profiles(spark, n=60):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        sick = bool(i % 2)
        base = rng.random(6) + (np.arange(6) * 0.8 if sick else 0)
        rows.append((i, i % 20, sick and i % 20 % 2 == 1, "SAXS" if i % 4 < 2 else "WAXS", 40.0, base.tolist()))
    return spark.createDataFrame(
        rows,
        "measurement_id long, patient_id long, cancer_diagnosis boolean, "
        "type_measurement string, age double, radial_profile_data array<double>",
    )


def test_pipeline_trains_exports_and_reloads(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier

    data = small_profiles(spark)
    work = models.MLPipeline(
        preprocessing_steps=[("extract", stages.ColumnExtractor(columns=["radial_profile_data"]))],
        estimator=("forest", RandomForestClassifier(numTrees=5, maxDepth=3, seed=1)),
    )
    with pytest.raises(RuntimeError):
        work.predict(data)
    with pytest.raises(RuntimeError):
        work.export_pipeline()
    work.add_preprocessing_step(
        "scale", stages.ColumnStandardizer(column="radial_profile_data"), position=0
    )
    assert [n for n, _ in work.preprocessing_steps] == ["scale", "extract"]
    metrics = work.train(data, "cancer_diagnosis", test_size=0.4, seed=2)
    assert set(metrics) == {
        "accuracy", "roc_auc", "sensitivity", "specificity", "precision", "ba_accuracy",
    }
    assert metrics["roc_auc"] > 90
    path = str(tmp_path / "model")
    work.export_pipeline(save_path=path)
    again = PipelineModel.load(path).transform(data)
    here = work.predict(data)
    a = {r["measurement_id"]: r["y_score"] for r in again.collect()}
    b = {r["measurement_id"]: r["y_score"] for r in here.collect()}
    assert a == b
    work.export_predictions(data, str(tmp_path / "out"))
    written = spark.read.csv(str(tmp_path / "out"), header=True)
    assert written.count() == 60 and written.columns == ["measurement_id", "cancer_diagnosis"]
    assert 0 <= work.validate_dataset(data, "cancer_diagnosis", preprocess=True)["accuracy"] <= 1


def test_patient_forest(spark):
    from ringfold.operators import scale

    data = scale.norm_scale(small_profiles(spark, 120), kinds=scale.TYPES)
    forest = models.PatientForest(5, 3, 3).fit(data)
    assert 0 <= forest.roc_auc <= 1
    per_patient = forest.predict(data)
    assert per_patient.count() == 20
    spread = forest.predict_proba(data, by_measurements=True)
    assert spread.count() == 120 and "p0" in spread.columns


def test_stage_settings_survive_saving(table, tmp_path):
    stage = stages.AzimuthalIntegration(npt=5, calibration_mode="poni")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = stages.AzimuthalIntegration.load(str(tmp_path / "stage"))
    assert again.settings == {"npt": 5, "calibration_mode": "poni"}


def test_images_are_reduced_before_any_exchange(table):
    out = stages.AzimuthalIntegration(npt=4, calibration_mode="poni").transform(table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan
    # below the deepest exchange the pixels are already aggregated
    after = plan.split("Generate posexplode")[0]
    assert after.rindex("partial_avg") > after.rindex("Exchange")
