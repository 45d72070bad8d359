"""The array-layout operators as Spark ML stages that can be saved.

Settings are kept as one JSON parameter, so a stage is written and read with
the standard ML persistence.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..operators import clean, fit, profile, scale, terms
from . import cells


class _Configured(Params):
    options = Param(
        Params._dummy(), "options", "settings as JSON", TypeConverters.toString
    )

    def __init__(self, **options):
        super().__init__()
        self._set(options=json.dumps(options))

    @property
    def settings(self) -> dict:
        return json.loads(self.getOrDefault(self.options))


class Stage(_Configured, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer defined by ``run``."""

    def run(self, df: DataFrame, **settings) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.run(dataset, **self.settings)


class AzimuthalIntegration(Stage):
    def run(self, df, **settings):
        return cells.integration(df, **settings)


class DeviationTransformer(Stage):
    def run(self, df, **settings):
        return cells.deviations(df, **settings)


class DataPreparation(Stage):
    def run(self, df, columns=None, no_poni=False):
        return clean.prepare(df, columns, no_poni)


class QRangeSetter(Stage):
    """Limits as a list: q_min_saxs, q_max_saxs, q_min_waxs, q_max_waxs."""

    def run(self, df, limits=None):
        return clean.set_q_range(df, clean.Limits(*limits) if limits else None)


class ColumnCleaner(Stage):
    """Rules as mappings with the fields of ``RuleQ``."""

    def run(self, df, rules=()):
        return clean.clean_q(df, [clean.RuleQ(**r) for r in rules])


class ColumnNormalizer(Stage):
    def run(self, df, column, norm="l1", mode="1D"):
        cell = F.col(column)
        if mode == "1D":
            return df.withColumn(column, scale.normalized(cell, norm))
        whole = scale.row_norm(F.flatten(cell), norm)
        # the norm rides along as a one-element array, computed once a row
        image = F.element_at(
            F.transform(
                F.array(whole),
                lambda size: F.transform(
                    cell,
                    lambda line: F.transform(
                        line, lambda v: F.when(size == 0, v).otherwise(v / size)
                    ),
                ),
            ),
            1,
        )
        return df.withColumn(column, image)


class ColumnExtractor(Stage):
    """Concatenate columns to ``features``, as an ML vector unless told not to."""

    def run(self, df, columns, name="features", as_vector=True):
        out = clean.extract_features(df, columns, name)
        return out.withColumn(name, array_to_vector(name)) if as_vector else out


class SlopeRemoval(Stage):
    def run(self, df, columns=("radial_profile_data",), mode=""):
        for column in columns:
            cell = F.col(column)
            df = df.withColumn(
                column,
                profile.slope_rotated(cell).getField("y")
                if mode == "custom"
                else profile.slope_removed(cell),
            )
        return df


class FourierTransform(Stage):
    """Mode ``custom`` (series), ``2D`` (image features) or else discrete."""

    def run(
        self,
        df,
        fourier_mode="",
        order=15,
        columns=("radial_profile_data",),
        shape=(256, 256),
        **image_settings,
    ):
        if fourier_mode == "2D":
            return cells.fourier_2d(df, columns[0], tuple(shape), **image_settings)
        return profile.fourier_cells(df, list(columns), order, fourier_mode)


class MeasurementCutter(Stage):
    def run(self, df, column, distances=()):
        return cells.cut_rings(df, column, list(distances))


class ImageResizer(Stage):
    def run(self, df, column, ref_distance, shape=(256, 256)):
        return cells.resize(df, column, ref_distance, tuple(shape))


class CommonRegionCutter(Stage):
    def run(self, df, column, square=False, shape=(256, 256)):
        return cells.cut_common(df, column, tuple(shape), square)


class HankelTransformer(Stage):
    def run(self, df, column, start_radius=0, order=0, shape=(360, 256)):
        return cells.hankel_cells(df, column, tuple(shape), start_radius, order)


class GoodnessAnalysisTransformer(Stage):
    def run(self, df, column, threshold=0.25, start_radius=0, shape=(360, 256)):
        return cells.goodness(df, column, tuple(shape), threshold, start_radius)


def _described(model: terms.TermSum) -> list[dict]:
    return [
        {
            "term": type(t).__name__,
            "parameters": [
                [p.value, p.min_value, p.max_value, p.returned] for p in t.parameters
            ],
        }
        for t in model.functions
    ]


def _rebuilt(described: list[dict]) -> terms.TermSum:
    return terms.TermSum(
        tuple(
            getattr(terms, d["term"])(*[terms.Parameter(*p) for p in d["parameters"]])
            for d in described
        )
    )


class CurveFitting(Stage):
    """Fit a sum of terms to array cells: adds ``fit_params_all``, one column per
    term, ``fit_cond`` and ``fitted_curve``; rows that fail are dropped."""

    @classmethod
    def of(cls, x_column, y_column, model: terms.TermSum, **settings):
        return cls(
            x_column=x_column, y_column=y_column, model=_described(model), **settings
        )

    def run(
        self, df, x_column, y_column, model, cutoff_ranges=None, grid=9, rounds=4
    ):
        curve = _rebuilt(model)
        points = df.select(
            cells.ID, F.posexplode(F.arrays_zip(x_column, y_column)).alias("pos", "_p")
        ).select(
            cells.ID,
            "pos",
            F.col(f"_p.{x_column}").alias("q"),
            F.col(f"_p.{y_column}").alias("intensity"),
        )
        cuts = [tuple(c) for c in cutoff_ranges or []]
        fitted = fit.fit(points, curve, grid=grid, rounds=rounds, cutoff_ranges=cuts)
        cond = fit.condition(points, fitted, curve, cutoff_ranges=cuts)
        params = [
            F.get("fit_params_all", F.lit(i)) for i in range(len(curve.initial_guess()))
        ]
        f = curve.produce_function()
        return (
            df.join(fitted, cells.ID)
            .join(cond, cells.ID)
            .withColumn("fitted_curve", F.transform(x_column, lambda x: f(x, *params)))
        )


class _ScalerModel(Stage):
    """Fitted scaler: means and scales per kind, in the settings."""

    def _table(self, df: DataFrame, kinds: list[dict]) -> DataFrame:
        return df.sparkSession.createDataFrame(
            [(k["kind"], k["mean"], k["scale"]) for k in kinds],
            "kind string, mean array<double>, scale array<double>",
        )


class StandardizerModel(_ScalerModel):
    def run(self, df, column, kinds):
        return scale.apply_scaler(df, self._table(df, kinds), column, column)


class NormScalerModel(_ScalerModel):
    def run(self, df, by, kinds):
        return scale.norm_scale(df, self._table(df, kinds), by)


def _fitted(scaler: DataFrame) -> list[dict]:
    """A fitted scaler, saved with the model: one row per kind."""
    rows = scaler.collect()
    return [
        {"kind": str(r["kind"]), "mean": list(r["mean"]), "scale": list(r["scale"])}
        for r in rows
    ]


class ColumnStandardizer(
    _Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable
):
    def _fit(self, dataset):
        column = self.settings["column"]
        return StandardizerModel(
            column=column, kinds=_fitted(scale.fit_scaler(dataset, column))
        )


class NormScaler(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """L1 norm and a scaler per measurement type (or per ``by``, all kinds)."""

    def _fit(self, dataset):
        by = self.settings.get("by", "type_measurement")
        kinds = scale.TYPES if by == "type_measurement" else None
        rows = dataset.withColumn(
            scale.NORM, scale.normalized(F.col("radial_profile_data"), "l1")
        )
        return NormScalerModel(
            by=by, kinds=_fitted(scale.fit_scaler(rows, scale.NORM, by, kinds))
        )


class Thresholded(Stage):
    """Adds ``y_score`` (probability of the positive class) and ``y_pred``."""

    def run(self, df, threshold=0.5):
        from pyspark.ml.functions import vector_to_array

        score = F.get(vector_to_array("probability"), F.lit(1))
        return df.withColumn("y_score", score).withColumn(
            "y_pred", F.col("y_score") > float(threshold)
        )
