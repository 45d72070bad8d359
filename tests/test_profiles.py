import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import profile_frame
from ringfold.functions import special
from ringfold.operators import clean, fit, profile, scale, spectrum, terms
from ringfold.operators.terms import Parameter


def cells(spark, curves):
    return spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in curves.items()],
        "measurement_id long, y array<double>",
    )


def test_slope_removal(spark):
    df = cells(spark, {1: [3 + 2 * i for i in range(9)], 2: [1, 5, 2]})
    out = {r[0]: r[1] for r in df.select("measurement_id", profile.slope_removed(F.col("y"))).collect()}
    assert np.allclose(out[1], 0)
    assert np.allclose(out[2], [0, 3.5, 0])
    rotated = df.select(profile.slope_rotated(F.col("y")).alias("r")).collect()[1]["r"]
    assert rotated["y"][0] == pytest.approx(0) and rotated["y"][-1] == pytest.approx(0)


def test_pure_cosine_has_one_coefficient(spark):
    n = 32
    points = profile_frame(spark, {1: np.cos(2 * np.pi * 3 * np.arange(n) / n)})
    row = profile.fourier_coefficients(points.drop("n_points"), 5).first()
    assert np.allclose(row["first"], [0, 0, n / 2, 0, 0]) and np.allclose(row["second"], 0)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 9])
def test_simpson_is_exact_on_parabolas(spark, n):
    w = [
        r[0]
        for r in spark.range(n)
        .select(profile.simpson_weight(F.col("id"), F.lit(n)))
        .collect()
    ]
    x = np.arange(n)
    assert np.dot(w, x) == pytest.approx((n - 1) ** 2 / 2)
    if n > 2:
        assert np.dot(w, x**2) == pytest.approx((n - 1) ** 3 / 3)


def test_low_pass_keeps_everything_when_the_order_is_high(spark):
    curve = np.random.default_rng(1).random(7)
    out = profile.fourier_inverse(profile_frame(spark, {1: curve}), 3).orderBy("pos")
    assert np.allclose([r["inverse"] for r in out.collect()], curve)


def test_hankel_kernel_is_its_own_inverse():
    for order in (0, 1, 2):
        n = 24
        k = special.hankel_kernel(order, n)
        last = special.bessel_zeros(order, n + 1)[n]
        # with R = 1 the transform back has V = S / (2 pi) in the place of R
        back = k * (last / (2 * np.pi)) ** 2
        assert np.allclose(k @ back, np.eye(n), atol=1e-5)


def test_bessel_values():
    assert special.bessel_zeros(0, 2) == pytest.approx([2.404825557695773, 5.520078110286311])
    assert special.bessel_zeros(1, 1) == pytest.approx([3.831705970207512])
    assert special.bessel_j(0, np.array([1.0]))[0] == pytest.approx(0.7651976865579666)


def test_special_columns(spark):
    xs = [0.1, 0.5, 0.9, 1.0, 2.5, 7.3, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    g = [r[0] for r in df.select(special.gamma(F.col("x"))).collect()]
    assert g == pytest.approx([math.gamma(x) for x in xs], rel=1e-12)
    zs = [-8.0, -3.0, -0.5, 0.0, 0.7, 2.0, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    p = [r[0] for r in df.select(special.normal_cdf(F.col("z"))).collect()]
    assert p == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], abs=1e-11)


def test_voigt_is_the_convolution_of_its_parts(spark):
    sigma, gamma, cen = 0.3, 0.2, 1.0
    xs = np.array([-1.0, 0.5, 1.0, 1.4, 3.0])
    t = np.linspace(-30, 30, 600_001)
    density = np.exp(-(t**2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi))
    want = [
        np.trapezoid(density * gamma / np.pi / ((x - cen - t) ** 2 + gamma**2), t) for x in xs
    ]
    one = Parameter(1.0)
    term = terms.VoigtPeak(one, one, one, one)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(term.calculate(F.col("x"), 1.0, cen, sigma, gamma)).collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_gamma_term_rejects_bad_shape(spark):
    one = Parameter(1.0)
    term = terms.GammaDistributionPeak(one, one, one, one)
    with pytest.raises(Exception, match="must be positive"):
        spark.range(1).select(term.calculate(F.lit(1.0), 1.0, 0.0, -1.0, 1.0)).collect()


def test_model_bookkeeping():
    p = Parameter
    model = terms.TermSum(
        (
            terms.InversePowerBackground(p(1, 0, 2), p(3), p(4, returned=False)),
            terms.GaussianPeak(p(5), p(6), p(7, 0.1)),
        )
    )
    assert model.get_function_count() == 2
    assert model.get_function_param_counts() == [3, 3]
    assert model.initial_guess() == [1, 3, 4, 5, 6, 7]
    assert model.returned_values() == [0, 1, 3, 4, 5]
    low, high = model.bounds()
    assert low[0] == 0 and low[5] == 0.1 and high[0] == 2 and math.isinf(high[1])


def test_fit_recovers_two_terms_and_zooms(spark):
    x = (np.arange(50) + 1) * 0.1
    y = 3 / (1 + ((x - 2.3) / 0.4) ** 2) + 0.8 / x**1.5 + 0.1
    p = Parameter
    model = terms.TermSum(
        (
            terms.LorentzianPeak(p(1, 0, 9), p(2, 1, 4), p(0.5, 0.1, 1)),
            terms.InversePowerBackground(p(1.2, 1, 2), p(1, 0, 9), p(0, -1, 1)),
        )
    )
    row = fit.fit(profile_frame(spark, {1: y}), model, grid=7, rounds=5).first()
    assert np.allclose(row["fit_params_all"], [3, 2.3, 0.4, 1.5, 0.8, 0.1], atol=0.02)
    with pytest.raises(ValueError):
        fit.fit(
            profile_frame(spark, {1: y}),
            terms.TermSum((terms.GaussianPeak(p(1), p(1), p(1)),)),
        )


def test_fit_ignores_cut_points(spark):
    x = (np.arange(40) + 1) * 0.1
    y = 2 * np.exp(-((x - 2.0) ** 2) / (2 * 0.5**2))
    y[:8] = 50
    p = Parameter
    model = terms.TermSum((terms.GaussianPeak(p(1, 0, 9), p(2, 1, 3), p(0.5, 0.2, 0.8)),))
    row = fit.fit(
        profile_frame(spark, {1: y}), model, grid=9, rounds=3, cutoff_ranges=[(0.0, 0.85)]
    ).first()
    assert np.allclose(row["fit_params_all"], [2, 2, 0.5], atol=1e-6)


def test_skewed_voigt_amplitude_counts_twice(spark):
    p = Parameter
    term = terms.SkewedVoigtPeak(p(1, 0, 5), p(2, 1, 3), p(0.4, 0.2, 0.6), p(0.2, 0.1, 0.3), p(1, 0, 2))
    points = profile_frame(spark, {1: np.zeros(40)}).withColumn(
        "intensity", term.calculate(F.col("q"), 3.0, 2.0, 0.4, 0.2, 1.0)
    )
    row = fit.fit(points, terms.TermSum((term,)), grid=3, rounds=1).first()
    assert np.allclose(row["fit_params_all"], [3, 2, 0.4, 0.2, 1.0])


def test_spectrum_parseval_and_mask(spark):
    from helpers import pixel_frame

    rng = np.random.default_rng(4)
    img = rng.random((6, 10))
    px = pixel_frame(spark, {1: img})
    power = spectrum.spectrum_2d(px, 6, 10).agg(
        F.sum(F.col("re") ** 2 + F.col("im") ** 2)
    ).first()[0]
    assert power == pytest.approx(60 * (img**2).sum())
    mask = spark.createDataFrame([(0, 0, 1)], "row_idx int, col_idx int, m int")
    cut = spectrum.image_spectrum(px, 6, 10, "fourier", mask=mask)
    plain = img.copy()
    plain[0, 0] = 0
    dc = cut.filter("u = 3 and v = 5").first()
    assert dc["re"] == pytest.approx(plain.sum()) and dc["norm"] == pytest.approx(img.sum())
    with pytest.raises(ValueError):
        spectrum.image_spectrum(px, 6, 10, "other")


def test_standardize_keeps_flat_positions(spark):
    df = cells(spark, {1: [1, 2, 5], 2: [3, 2, 5], 3: [5, 2, 5]})
    got = {r[0]: r["y"] for r in scale.standardize(df, "y").collect()}
    assert got[1] == pytest.approx([-math.sqrt(1.5), 0, 0])


def test_zero_profile_survives_normalization(spark):
    df = cells(spark, {1: [0, 0, 0]})
    assert df.select(scale.normalized(F.col("y"), "l1")).first()[0] == [0, 0, 0]


def test_other_types_are_not_scaled(spark):
    df = spark.createDataFrame(
        [(1, "SAXS", [1.0, 2.0]), (2, "SAXS", [2.0, 2.0]), (3, "OTHER", [1.0, 1.0])],
        "measurement_id long, type_measurement string, radial_profile_data array<double>",
    )
    got = {r[0]: r[scale.SCALED] for r in scale.norm_scale(df, kinds=scale.TYPES).collect()}
    assert got[3] is None and got[1] == pytest.approx([-1, 1])


def test_clean_rules(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], [5.0, 6.0]), (2, [1.0, 2.0], [5.0, 9.0]), (3, [0.1, 0.2], [0.0, 0.0])],
        "measurement_id long, q array<double>, y array<double>",
    )
    rule = clean.RuleQ("y", "q", 1.9, lower=5.0, upper=9.0)
    assert {r[0] for r in clean.clean_q(df, [rule]).collect()} == {1, 3}
    assert {r[0] for r in clean.clean_q(df, [clean.RuleQ("y", "q", 1.9)]).collect()} == {3}
    with pytest.raises(TypeError):
        clean.clean_q(df, ["rule"])


def test_prepare_repairs_images(spark):
    df = spark.createDataFrame(
        [
            (1, [[float("nan"), 1.0], [float("inf"), None]], "text", None, 0.01),
            (2, [[1.0]], None, 30.0, 0.2),
        ],
        "measurement_id long, measurement_data array<array<double>>, ponifile string, "
        "age double, calculated_distance double",
    )
    columns = ["measurement_id", "measurement_data", "age", "type_measurement", "ponifile"]
    row = clean.prepare(df, columns).collect()
    assert len(row) == 1 and row[0]["age"] == -1 and row[0]["type_measurement"] == "WAXS"
    assert row[0]["measurement_data"] == [[0.0, 1.0], [1.7976931348623157e308, 0.0]]
    assert "ponifile" not in clean.prepare(df, columns, no_poni=True).columns
    assert columns[-1] == "ponifile"


def test_bound_that_binds_moves_the_other_parameter(spark):
    """A dip cannot be fitted with a positive amplitude: the constant alone is
    then the mean, not what it was beside the negative amplitude."""
    q = 0.1 * np.arange(1, 65)
    y = 3.0 - 2.0 * np.exp(-(((q - 3.0) / 0.5) ** 2) / 2)
    model = terms.TermSum(
        (
            terms.GaussianPeak(
                terms.Parameter(1.0, 0.0, 10.0), terms.Parameter(3.0, 2.9, 3.1), terms.Parameter(0.5, 0.4, 0.6)
            ),
            terms.ConstantBackground(terms.Parameter(0.0, -5.0, 5.0)),
        )
    )
    row = fit.fit(profile_frame(spark, {1: y}), model, grid=3, rounds=1).first()
    assert abs(row["fit_params_0"][0]) < 1e-9
    assert abs(row["fit_params_1"][0] - y.mean()) < 1e-6
    assert abs(row["sse"] - ((y - y.mean()) ** 2).sum()) < 1e-6


def test_overlapping_peaks_with_a_binding_bound():
    """Two peaks of width 0.6, 0.1 apart, and a constant at its bound."""
    q = 0.1 * np.arange(1, 65)
    basis = np.stack([np.exp(-(((q - c) / 0.6) ** 2) / 2) for c in (3.0, 3.1)] + [np.ones(64)], axis=1)
    y = basis @ [1.8, 2.9, 0.4] + 0.05 * np.sin(7 * q)
    bounds = [(0.0, 10.0), (0.0, 10.0), (0.5, 2.0)]
    found = fit.bounded_solution((basis.T @ basis)[None], (basis.T @ y)[None], bounds)[0]
    assert found[2] == 0.5
    free = np.linalg.lstsq(basis[:, :2], y - 0.5, rcond=None)[0]
    assert np.allclose(found[:2], free, atol=1e-9)


def test_bounded_solution_equals_all_sets_of_bounds():
    rng = np.random.default_rng(1)
    bounds = [(-0.3, 0.2), (0.0, 1.0), (-1.0, 0.05), (0.1, 0.1)]
    for m in (1, 2, 3, 4):
        a = rng.normal(size=(60, 9, m)).cumsum(axis=2) * 0.3
        y = rng.normal(size=(60, 9)) * 2
        g, r = np.einsum("nki,nkj->nij", a, a), np.einsum("nki,nk->ni", a, y)
        found = fit.bounded_solution(g.copy(), r.copy(), bounds[:m])
        for i in range(60):
            best = math.inf
            for way in itertools.product((0, 1, None), repeat=m):
                x = np.array([bounds[j][w] if w is not None else 0.0 for j, w in enumerate(way)])
                free = [j for j in range(m) if way[j] is None]
                if free:
                    x[free] = np.linalg.solve(g[i][np.ix_(free, free)], r[i][free] - g[i][free] @ x)
                if all(lo - 1e-12 <= v <= hi + 1e-12 for v, (lo, hi) in zip(x, bounds)):
                    best = min(best, ((a[i] @ x - y[i]) ** 2).sum())
            assert ((a[i] @ found[i] - y[i]) ** 2).sum() == pytest.approx(best, abs=1e-9)
            assert all(lo <= v <= hi for v, (lo, hi) in zip(found[i], bounds))
    nothing = fit.bounded_solution(np.full((1, 2, 2), np.nan), np.ones((1, 2)), bounds[:2])
    assert np.isnan(nothing).all()


def test_background_and_two_peaks(spark):
    q = 0.1 * np.arange(1, 65)

    def curve(c1, c2):
        return (
            0.7 / q + 0.3 + 3 * np.exp(-((q - c1) ** 2) / (2 * 0.3**2)) + 1.5 / (1 + ((q - c2) / 0.4) ** 2)
        )

    p = terms.Parameter
    model = terms.TermSum(
        (
            terms.InversePowerBackground(p(1.2, 0.5, 2), p(1, 0, 9), p(0, -1, 1)),
            terms.GaussianPeak(p(1, 0, 9), p(2.2, 1, 3), p(0.4, 0.1, 1)),
            terms.LorentzianPeak(p(1, 0, 9), p(4.2, 3, 6), p(0.5, 0.1, 1)),
        )
    )
    rows = fit.fit(profile_frame(spark, {1: curve(2.0, 4.5), 2: curve(2.3, 4.0)}), model, grid=7, rounds=5)
    got = {r["measurement_id"]: r for r in rows.collect()}
    assert np.allclose(got[1]["fit_params_all"], [1, 0.7, 0.3, 3, 2.0, 0.3, 1.5, 4.5, 0.4], atol=0.05)
    assert np.allclose(got[2]["fit_params_2"][1], 4.0, atol=0.05) and got[2]["sse"] < 1e-2


def test_bessel_in_blocks_equals_the_whole():
    x = np.linspace(0, 400, 6000).reshape(60, 100)
    whole = [special.bessel_j(1, np.append(row, 400.0))[:-1] for row in x]
    assert np.allclose(special.bessel_j(1, x), whole, atol=1e-14)
    assert special.bessel_j(0, np.zeros(0)).shape == (0,)
