"""Training, validation and export of classifiers on measurement tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from ..functions.skew import attach
from ..operators import evaluate, split
from ..operators.clean import infer_label
from ..operators.integrate import ID
from ..operators.patients import FEATURES, patient_features
from ..operators.scale import SCALED
from .stages import Thresholded

Steps = list[tuple[str, object]]
Splitter = Callable[..., tuple[DataFrame, DataFrame]]


def random_split(
    df: DataFrame, test_size: float = 0.25, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    parts = split.split_random(df, test_size, seed)
    return (
        parts.filter(F.col("part") == "train").drop("part"),
        parts.filter(F.col("part") == "test").drop("part"),
    )


class MLPipeline:
    """Named steps in three parts: wrangling (per row, never fitted),
    preprocessing (fitted on the training part only) and an estimator that reads
    ``features`` and ``label``."""

    def __init__(
        self,
        data_wrangling_steps: Steps | None = None,
        splitter: Splitter = random_split,
        preprocessing_steps: Steps | None = None,
        estimator: tuple[str, object] | None = None,
    ):
        self.data_wrangling_steps = list(data_wrangling_steps or [])
        self.splitter = splitter
        self.preprocessing_steps = list(preprocessing_steps or [])
        self.estimator = estimator
        self.trained_preprocessor: PipelineModel | None = None
        self.trained_estimator: Transformer | None = None
        self.optimal_threshold: float | None = None

    @staticmethod
    def _insert(steps: Steps, name: str, stage, position: int | None) -> None:
        steps.insert(len(steps) if position is None else position, (name, stage))

    def add_data_wrangling_step(self, name, transformer, position=None):
        self._insert(self.data_wrangling_steps, name, transformer, position)

    def add_preprocessing_step(self, name, transformer, position=None):
        self._insert(self.preprocessing_steps, name, transformer, position)

    def set_estimator(self, estimator):
        self.estimator = estimator

    def set_splitter(self, splitter):
        self.splitter = splitter

    def wrangle(self, data: DataFrame) -> DataFrame:
        return PipelineModel([s for _, s in self.data_wrangling_steps]).transform(data)

    def train_preprocessor(self, data: DataFrame) -> PipelineModel:
        stages = [s for _, s in self.preprocessing_steps]
        self.trained_preprocessor = Pipeline(stages=stages).fit(data)
        return self.trained_preprocessor

    def preprocess(self, data: DataFrame) -> DataFrame:
        if self.trained_preprocessor is None:
            raise RuntimeError("train the preprocessing first")
        return self.trained_preprocessor.transform(data)

    def train_preprocess(self, data: DataFrame) -> DataFrame:
        self.train_preprocessor(data)
        return self.preprocess(data)

    def wrangle_preprocess_transform(self, data, train: bool = True) -> DataFrame:
        wrangled = self.wrangle(data)
        if train:
            self.train_preprocessor(wrangled)
        return self.preprocess(wrangled)

    @staticmethod
    def infer_y(data: DataFrame, y_column: str, y_value=None) -> DataFrame:
        """Add ``label``: the column, or whether it equals ``y_value``."""
        label = infer_label(data, y_column, y_value)
        return data.withColumn("label", label.cast("double"))

    def train_estimator(self, data: DataFrame) -> Transformer:
        self.trained_estimator = self.estimator[1].fit(data)
        return self.trained_estimator

    def _ready(self, data: DataFrame, wrangle: bool, preprocess: bool) -> DataFrame:
        if self.trained_estimator is None:
            raise RuntimeError("train the estimator first")
        if wrangle:
            data = self.wrangle(data)
        return self.preprocess(data) if preprocess else data

    def predict(self, data, wrangle: bool = False, preprocess: bool = True) -> DataFrame:
        """Rows with ``prediction``, ``probability`` and ``y_score``."""
        ready = self._ready(data, wrangle, preprocess)
        scored = self.trained_estimator.transform(ready)
        return scored.withColumn(
            "y_score", F.get(vector_to_array("probability"), F.lit(1))
        )

    predict_proba = predict

    def validate(self, scored: DataFrame, **settings) -> dict:
        """Metrics of rows with ``y_true`` and ``y_score``; keeps the threshold."""
        row = evaluate.validate(scored, **settings).first().asDict()
        self.optimal_threshold = row.pop("optimal_threshold")
        return row

    def train(
        self,
        data: DataFrame,
        y_column: str,
        y_value=None,
        wrangle: bool = True,
        split: bool = True,
        preprocess: bool = True,
        min_sensitivity: float | None = None,
        min_specificity: float | None = None,
        **split_args,
    ) -> dict:
        """Wrangle, label, split, fit and validate on the held-out part. What is
        read several times is written once: the wrangled rows, the estimator's
        input and the scored rows."""
        if wrangle:
            data = written(self.wrangle(data), "wrangled")
        data = self.infer_y(data, y_column, y_value)
        train, test = self.splitter(data, **split_args) if split else (data, data)
        if preprocess:
            train = self.train_preprocess(train)
        columns = [self.estimator[1].getFeaturesCol(), "label"]
        self.train_estimator(written(train.select(*columns), "train"))
        scored = self.predict(test, preprocess=preprocess)
        return self.validate(
            written(scored.select(F.col("label").alias("y_true"), "y_score"), "scored"),
            min_sensitivity=min_sensitivity,
            min_specificity=min_specificity,
        )

    def validate_dataset(
        self,
        data: DataFrame,
        y_column: str,
        y_value=None,
        wrangle: bool = False,
        preprocess: bool = False,
        **settings,
    ) -> dict:
        scored = self.predict(self.infer_y(data, y_column, y_value), wrangle, preprocess)
        pairs = scored.select(F.col("label").alias("y_true"), "y_score")
        return self.validate(written(pairs, "scored"), **settings)

    def export_pipeline(
        self, wrangle: bool = False, preprocess: bool = True, save_path: str | None = None
    ) -> PipelineModel:
        """The chosen steps, the estimator and the threshold as one saved model."""
        if self.trained_estimator is None:
            raise RuntimeError("train the estimator first")
        stages = [s for _, s in self.data_wrangling_steps] if wrangle else []
        if preprocess:
            stages += self.trained_preprocessor.stages
        threshold = 0.5 if self.optimal_threshold is None else self.optimal_threshold
        model = PipelineModel(
            [*stages, self.trained_estimator, Thresholded(threshold=threshold)]
        )
        if save_path:
            model.write().overwrite().save(save_path)
        return model

    def export_predictions(
        self, data: DataFrame, save_path: str, wrangle=False, preprocess=True
    ) -> None:
        """Write measurement_id and cancer_diagnosis as CSV."""
        model = self.export_pipeline(wrangle, preprocess)
        model.transform(data).select(
            ID, F.col("y_pred").alias("cancer_diagnosis")
        ).write.mode("overwrite").csv(save_path, header=True)


class PatientForest:
    """Two layers of forests: one per measurement type on scaled profiles, then
    one on the features of each patient."""

    def __init__(
        self,
        n_estimators_first: int = 100,
        max_depth_first: int = 10,
        max_depth_second: int = 10,
        random_state: int = 32,
        split: float = 0.4,
        bootstrap: bool = True,
    ):
        self.bootstrap = bootstrap
        self.n_estimators = n_estimators_first
        self.max_depth_first = max_depth_first
        self.max_depth_second = max_depth_second
        self.random_state = random_state
        self.split = split

    def _forest(self, depth: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            numTrees=self.n_estimators,
            maxDepth=depth,
            seed=self.random_state,
            bootstrap=self.bootstrap,
            featuresCol="_v",
            labelCol="_y",
        )

    def first_layer(self, train: DataFrame) -> None:
        rows = train.withColumns(
            {
                "_v": array_to_vector(SCALED),
                "_y": F.col("cancer_diagnosis").cast("double"),
            }
        )
        self.layers = {
            kind: self._forest(self.max_depth_first).fit(
                rows.filter(F.col("type_measurement") == kind)
            )
            for kind in ("SAXS", "WAXS")
        }

    def score(self, df: DataFrame) -> DataFrame:
        """Class probabilities of every SAXS and WAXS row."""
        rows = df.withColumn("_v", array_to_vector(SCALED))
        parts = []
        for kind, model in self.layers.items():
            scored = model.transform(rows.filter(F.col("type_measurement") == kind))
            p = vector_to_array("probability")
            parts.append(
                scored.select(
                    *df.columns,
                    F.get(p, F.lit(0)).alias("p0"),
                    F.get(p, F.lit(1)).alias("p1"),
                )
            )
        return parts[0].unionByName(parts[1])

    def features(self, df: DataFrame, label: bool = True) -> DataFrame:
        """Patient features as a vector; a distance without pairs counts as -1."""
        rows = patient_features(
            self.score(df), SCALED, "cancer_diagnosis" if label else None
        )
        filled = rows.na.fill(-1.0, FEATURES)
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="_v").transform(filled)
        if label:
            return assembled.withColumn("_y", F.col("label").cast("double"))
        return assembled

    def fit(self, df: DataFrame) -> "PatientForest":
        columns = [
            ID,
            "patient_id",
            "type_measurement",
            "cancer_diagnosis",
            "age",
            SCALED,
        ]
        # a forest reads its input many times: each input is written once
        rows = written(df.select(*columns), "scaled")
        parts = split.split_stratified_patients(rows, self.split, self.random_state)
        train, test = (written(part, "patients") for part in parts)
        self.first_layer(train)
        self.decider = self._forest(self.max_depth_second).fit(
            written(self.features(train), "features")
        )
        scored = written(
            self.decider.transform(self.features(test)).select(
                F.col("_y").alias("y_true"),
                F.get(vector_to_array("probability"), F.lit(1)).alias("y_score"),
                (F.col("prediction") == F.col("_y")).alias("_right"),
            ),
            "scored",
        )
        self.accuracy = scored.agg(F.avg(F.col("_right").cast("double"))).first()[0]
        groups = evaluate.score_groups(scored)
        self.roc = evaluate.roc_points(groups)
        self.roc_auc = evaluate.roc_auc(groups).first()[0]
        best = evaluate.optimal_threshold(self.roc).first()
        self.optimal_threshold = best["threshold"]
        self.optimal_sensitivity = best["tpr"]
        self.optimal_specificity = None if best["fpr"] is None else 1 - best["fpr"]
        return self

    def _decided(self, df: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        return self.decider.transform(self.features(df, label=False)).select(
            "patient_id",
            F.col("prediction").cast("int").alias("prediction"),
            F.get(p, F.lit(0)).alias("p0"),
            F.get(p, F.lit(1)).alias("p1"),
        )

    def predict(self, df: DataFrame, by_measurements: bool = False) -> DataFrame:
        decided = self._decided(df).select("patient_id", "prediction")
        return self._spread(df, decided) if by_measurements else decided

    def predict_proba(self, df: DataFrame, by_measurements: bool = False) -> DataFrame:
        """Per patient both probabilities; per measurement that of class 0."""
        decided = self._decided(df)
        if by_measurements:
            return self._spread(df, decided.select("patient_id", "p0"))
        return decided.select("patient_id", "p0", "p1")

    @staticmethod
    def _spread(df: DataFrame, decided: DataFrame) -> DataFrame:
        rows = df.select(ID, "patient_id")
        return attach(rows, decided, ["patient_id"], [ID], "left")
