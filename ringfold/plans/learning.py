"""Registered queries that train and export models. Forests of many trees have
no SQL; each step is also shown with a model that has: Gaussian naive Bayes, and
a forest of one tree with one split."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.sql import Window, functions as F

from ..functions.columns import tidy
from ..functions.lineage import scratch_path
from ..ml import models, stages
from ..operators import scale
from ..sources import adapters
from .cohort import OPTIMUM, ROC_ONE, VALIDATE
from .images import ID
from .oracle import with_tables

TREES, DEPTH = 100, 10


def _workflow() -> models.MLPipeline:
    work = models.MLPipeline(
        data_wrangling_steps=[("slope", stages.SlopeRemoval())],
        preprocessing_steps=[
            ("scale", stages.ColumnStandardizer(column="radial_profile_data"))
        ],
        estimator=(
            "forest",
            RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3),
        ),
    )
    work.add_preprocessing_step(
        "extract", stages.ColumnExtractor(columns=["radial_profile_data"])
    )
    return work


def _trained(spark, d):
    work = _workflow()
    data = adapters.profile_arrays(spark, d)
    metrics = work.train(data, "cancer_diagnosis", test_size=0.3, seed=5)
    return work, data, metrics


def ml_train(spark, d):
    _, _, metrics = _trained(spark, d)
    return spark.createDataFrame([metrics])


def ml_predict(spark, d):
    work, data, _ = _trained(spark, d)
    return work.predict(data, wrangle=True).select(ID, "prediction", "y_score")


def ml_stages(spark, d):
    """Wrangling and fitted preprocessing without a model."""
    work = _workflow()
    out = work.wrangle_preprocess_transform(adapters.profile_arrays(spark, d))
    return out.select(
        ID, F.posexplode("radial_profile_data").alias("pos", "value")
    ).select(ID, F.col("pos").cast("long").alias("pos"), tidy(F.col("value"), 5).alias("value"))


# Points whose slope-free value varies; both ends are 0 in every profile.
ML_STAGES = with_tables(
    "profiles",
    """
, ends as (
    select measurement_id, max(n_points) as n, arg_min(intensity, pos) as y0,
           arg_max(intensity, pos) as y1 from profiles group by 1)
, flat as (
    select measurement_id, pos, n, intensity - y0 - (y1 - y0) * pos / (n - 1) as y
    from profiles join ends using (measurement_id))
select measurement_id, pos,
       case when pos = 0 or pos = n - 1 then 0 else round((y - avg(y) over (partition by pos))
           / stddev_pop(y) over (partition by pos), 5) + 0.0 end as value
from flat""",
)


def export_model(spark, d):
    """Save the whole chain, read it back and apply it to raw rows."""
    work, data, _ = _trained(spark, d)
    path = scratch_path(spark, "model")
    work.export_pipeline(wrangle=True, preprocess=True, save_path=path)
    return PipelineModel.load(path).transform(data).select(ID, "y_score", "y_pred")


def export_predictions(spark, d):
    work, data, _ = _trained(spark, d)
    path = scratch_path(spark, "predictions")
    work.export_predictions(data, path, wrangle=True)
    return spark.read.csv(
        path, header=True, schema="measurement_id bigint, cancer_diagnosis boolean"
    )


def _scaled(spark, d):
    return scale.norm_scale(adapters.profile_arrays(spark, d), kinds=scale.TYPES)


def _forest() -> models.PatientForest:
    return models.PatientForest(TREES, DEPTH, DEPTH)


def rf_first_layer(spark, d):
    forest = _forest()
    rows = _scaled(spark, d)
    forest.first_layer(rows)
    return forest.score(rows).select(ID, "type_measurement", "p0", "p1")


def rf_second_layer(spark, d):
    forest = _forest().fit(_scaled(spark, d))
    return forest.roc.select("threshold", "tpr", "fpr")


def rf_predict(spark, d):
    rows = _scaled(spark, d)
    return _forest().fit(rows).predict_proba(rows, by_measurements=True)


def _bayes(spark, d):
    """The same chain with a model whose scores SQL can state."""
    work = _workflow()
    work.set_estimator(("bayes", NaiveBayes(modelType="gaussian")))
    data = adapters.profile_arrays(spark, d)
    metrics = work.train(data, "cancer_diagnosis", test_size=0.3, seed=5, min_specificity=0.7)
    return work, data, metrics


def bayes_train(spark, d):
    _, _, metrics = _bayes(spark, d)
    return spark.createDataFrame([metrics]).withColumn("accuracy", tidy("accuracy")).drop("optimal_threshold")


def bayes_predict(spark, d):
    work, data, _ = _bayes(spark, d)
    return work.predict(data, wrangle=True).select(ID, "prediction", tidy("y_score").alias("y_score"))


def bayes_export_model(spark, d):
    work, data, _ = _bayes(spark, d)
    path = scratch_path(spark, "model")
    work.export_pipeline(wrangle=True, preprocess=True, save_path=path)
    return PipelineModel.load(path).transform(data).select(ID, tidy("y_score").alias("y_score"), "y_pred")


def bayes_export_predictions(spark, d):
    work, data, _ = _bayes(spark, d)
    path = scratch_path(spark, "predictions")
    work.export_predictions(data, path, wrangle=True)
    return spark.read.csv(
        path, header=True, schema="measurement_id bigint, cancer_diagnosis boolean"
    )


# Class moments of the training rows; a variance is raised by a billionth of the
# largest one, as the library does.
BAYES = """
, ends as (
    select measurement_id, max(n_points) as n, arg_min(intensity, pos) as y0,
           arg_max(intensity, pos) as y1 from profiles group by 1)
, flat as (
    select measurement_id, pos, cancer_diagnosis::int as label,
           case when pos = 0 or pos = n - 1 then 0 else intensity - y0 - (y1 - y0) * pos / (n - 1) end as y,
           md5(measurement_id || ':5')[:8] < '4ccccccc' as test
    from profiles join ends using (measurement_id))
, spread as (
    select pos, avg(y) as mu, stddev_pop(y) as sd from flat where not test group by 1)
, z as (
    select measurement_id, pos, label, test, (y - mu) / case when sd > 1e-12 then sd else 1 end as z
    from flat join spread using (pos))
, classes as (
    select pos, label, count(*) as n, avg(z) as m, var_pop(z) as v from z where not test group by all)
, largest as (
    select max(v) * 1e-9::double as eps from (select var_pop(z) as v from z where not test group by pos))
, logs as (
    select measurement_id, z.label as truth, test, c.label, max(ln(c.n)) as prior,
           sum(-ln(v + eps) / 2 - (z - m) ** 2 / (2 * (v + eps))) as l
    from z join classes c using (pos), largest group by all)
, told as (
    select measurement_id, any_value(truth) as y_true, any_value(test) as test,
           1 / (1 + exp(sum(case when label = 0 then prior + l else -prior - l end))) as y_score
    from logs group by 1)
, scored as (select y_true, y_score from told where test)
"""
CHOSEN = BAYES + ROC_ONE + OPTIMUM + ", f as (select * from best where rn = 1 and rule = 'free')\n"


def _coarse(spark, d):
    """Scaled profiles in few steps, so that every split can be tried."""
    steps = F.transform(scale.SCALED, lambda v: F.floor(v * 2) / 2)
    return _scaled(spark, d).withColumn(scale.SCALED, steps)


def rf_one_split(spark, d):
    """The first layer with one tree of one split per measurement type."""
    forest = models.PatientForest(1, 1, 1, bootstrap=False)
    rows = _coarse(spark, d)
    forest.first_layer(rows)
    return forest.score(rows).select(ID, "type_measurement", tidy("p0").alias("p0"), tidy("p1").alias("p1"))


def rf_units(spark, d):
    """What holds for any forest: one row per measurement with the class 0 score
    of its patient, and one per patient whose two scores sum to 1."""
    rows = _scaled(spark, d)
    forest = models.PatientForest(20, 4, 4).fit(rows)
    patients = forest.predict_proba(rows)
    sound = F.col("p0").between(0, 1) & (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9)
    own = patients.select("patient_id", F.col("p0").alias("_own"), sound.alias("sound"))
    spread = forest.predict_proba(rows, by_measurements=True)
    return spread.join(own, "patient_id").select(
        ID, "patient_id", "sound", (F.col("p0") == F.col("_own")).alias("same")
    )


def rf_roc_shape(spark, d):
    """The second layer's curve on held-out patients: from (0, 0) to (1, 1), never
    falling, and its area and accuracy are shares."""
    forest = models.PatientForest(20, 4, 4).fit(_scaled(spark, d))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("threshold"))
    steps = forest.roc.select(
        "tpr", "fpr",
        (F.col("tpr") >= F.lag("tpr", 1, 0.0).over(order)).alias("up"),
        (F.col("fpr") >= F.lag("fpr", 1, 0.0).over(order)).alias("right"),
    )
    return steps.agg(
        F.min("tpr").alias("tpr_low"), F.max("tpr").alias("tpr_high"),
        F.min("fpr").alias("fpr_low"), F.max("fpr").alias("fpr_high"),
        F.bool_and(F.col("up") & F.col("right")).alias("rising"),
    ).withColumn("shares", F.lit(0 <= forest.roc_auc <= 1 and 0 <= forest.accuracy <= 1))


# The split with the largest fall of the Gini impurity among all values of all
# positions; a leaf gives the class shares of its rows.
ONE_SPLIT = """
, normed as (
    select *, sum(abs(intensity)) over (partition by measurement_id) as norm from profiles)
, scaled as (
    select measurement_id, type_measurement as kind, pos, cancer_diagnosis::int as y,
           case when norm > 0 then intensity / norm else 0 end as x from normed)
, stats as (select kind, pos, avg(x) as mu, stddev_pop(x) as sd from scaled group by all)
, coarse as (
    select measurement_id, kind, pos, y,
           floor(((x - mu) / case when sd > 0 then sd else 1 end) * 2) / 2 as x
    from scaled join stats using (kind, pos))
, steps as (
    select kind, pos, x, count(*) as n, sum(y) as p from coarse group by all)
, sums as (
    select *, sum(n) over w as nl, sum(p) over w as pl, sum(n) over (partition by kind, pos) as na,
           sum(p) over (partition by kind, pos) as pa, lead(x) over (partition by kind, pos order by x) as x2
    from steps window w as (partition by kind, pos order by x))
, gains as (
    select *, (nl - (pl * pl + (nl - pl) * (nl - pl)) / nl::double
               + (na - nl) - ((pa - pl) * (pa - pl) + (na - nl - pa + pl) * (na - nl - pa + pl)) / (na - nl)::double) as left_over
    from sums where x2 is not null)
, split as (
    select * from (select *, row_number() over (partition by kind order by left_over, pos, x) as rn from gains) where rn = 1)
select c.measurement_id, c.kind as type_measurement,
       round(1 - case when c.x <= s.x then s.pl / s.nl::double else (s.pa - s.pl) / (s.na - s.nl)::double end, 6) as p0,
       round(case when c.x <= s.x then s.pl / s.nl::double else (s.pa - s.pl) / (s.na - s.nl)::double end, 6) as p1
from coarse c join split s on s.kind = c.kind and s.pos = c.pos"""

QUERIES = {
    "ml_stages": (ml_stages, ML_STAGES),
    "ml_train": (ml_train, None),
    "ml_predict": (ml_predict, None),
    "export_model": (export_model, None),
    "export_predictions": (export_predictions, None),
    "rf_first_layer": (rf_first_layer, None),
    "rf_second_layer": (rf_second_layer, None),
    "rf_predict": (rf_predict, None),
    "bayes_train": (
        bayes_train,
        with_tables("profiles", BAYES + "\n" + VALIDATE[VALIDATE.index(", steps as") :].replace("f.threshold as optimal_threshold, ", "")),
    ),
    "bayes_predict": (
        bayes_predict,
        with_tables("profiles", BAYES + """select measurement_id, (y_score > 0.5)::int::double as prediction,
            round(y_score, 6) + 0.0 as y_score from told"""),
    ),
    "bayes_export_model": (
        bayes_export_model,
        with_tables("profiles", CHOSEN + "select measurement_id, round(y_score, 6) + 0.0 as y_score, y_score > threshold as y_pred from told, f"),
    ),
    "bayes_export_predictions": (
        bayes_export_predictions,
        with_tables("profiles", CHOSEN + "select measurement_id, y_score > threshold as cancer_diagnosis from told, f"),
    ),
    "rf_one_split": (rf_one_split, with_tables("profiles", ONE_SPLIT)),
    "rf_units": (
        rf_units,
        with_tables("profiles", "select distinct measurement_id, patient_id, true as sound, true as same from profiles"),
    ),
    "rf_roc_shape": (
        rf_roc_shape,
        """select 0.0::double as tpr_low, 1.0::double as tpr_high, 0.0::double as fpr_low, 1.0::double as fpr_high,
        true as rising, true as shares""",
    ),
}
