"""Small tables for the tests."""

import numpy as np

CALIBRATION = {
    "distance_m": 0.16,
    "poni1": 0.00241,
    "poni2": 0.00233,
    "pixel1": 0.00015,
    "pixel2": 0.00015,
    "wavelength_nm": 0.1542,
}

TEXT = (
    "Detector: Detector\n"
    'Detector_config: {"pixel1": 0.00015, "pixel2": 0.00015}\n'
    "Distance: 0.16\nPoni1: 0.00241\nPoni2: 0.00233\nWavelength: 1.542e-10"
)


def pixel_frame(spark, images, skip_zero=False):
    rows = [
        (i, r, c, float(v))
        for i, image in images.items()
        for (r, c), v in np.ndenumerate(np.asarray(image))
        if not (skip_zero and v == 0)
    ]
    return spark.createDataFrame(
        rows, "measurement_id long, row_idx int, col_idx int, value double"
    )


def calibrated(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CALIBRATION.items()})


def geometry(spark, images, n):
    from ringfold.operators import calibration

    rows = calibration.full_q_range(calibrated(pixel_frame(spark, images)), n, n)
    return calibration.with_geometry(rows)


def q_grid(n):
    """The same geometry in numpy."""
    k = CALIBRATION
    y = (np.arange(n)[:, None] + 0.5) * k["pixel1"] - k["poni1"]
    x = (np.arange(n)[None, :] + 0.5) * k["pixel2"] - k["poni2"]
    r = np.sqrt(x**2 + y**2)
    q = 4 * np.pi / k["wavelength_nm"] * np.sin(np.arctan2(r, k["distance_m"]) / 2)
    return q, np.degrees(np.arctan2(y, x))


def profile_frame(spark, curves):
    rows = [
        (i, p, (p + 1) * 0.1, float(v), len(curve))
        for i, curve in curves.items()
        for p, v in enumerate(curve)
    ]
    return spark.createDataFrame(
        rows,
        "measurement_id long, pos int, q double, intensity double, n_points int",
    )
