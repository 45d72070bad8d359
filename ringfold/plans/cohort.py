"""Registered queries over cohorts: splits, ROC evaluation, patients, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import tidy
from ..operators import cluster, evaluate, patients, scale, split
from ..sources import adapters
from .curves import NORM_SCALE
from .images import ID
from .oracle import with_tables

SEED = 7


def split_patient_balanced(spark, d):
    train, test = split.split_patient_balanced(
        adapters.measurements(spark, d), 0.3, SEED
    )
    return split.marked(train, test, ID, "patient_id", "cancer_diagnosis")


BALANCED = with_tables(
    "measurements",
    f"""
, sizes as (
    select patient_id, cancer_diagnosis, count(*) as n,
           md5(patient_id || ':{SEED}') as h from measurements group by 1, 2)
, seen as (
    select *, coalesce(sum(n) over (partition by cancer_diagnosis order by h, patient_id
                  rows between unbounded preceding and 1 preceding), 0) as before,
           sum(n) over (partition by cancer_diagnosis) as class_n,
           (select count(*) from measurements) as total from sizes)
, taken as (
    select distinct patient_id from seen
    where before <= floor(floor((1 - 0.3::double) * total) * (class_n / total)))
select measurement_id, patient_id, cancer_diagnosis,
       if(patient_id in (select patient_id from taken), 'train', 'test') as part
from measurements""",
)


def split_stratified_patients(spark, d):
    train, test = split.split_stratified_patients(
        adapters.measurements(spark, d), 0.4, SEED
    )
    return split.marked(train, test, ID, "patient_id", "cancer_diagnosis")


STRATIFIED = with_tables(
    "measurements",
    f"""
, pairs as (select distinct patient_id, cancer_diagnosis from measurements)
, ranked as (
    select *, row_number() over (partition by cancer_diagnosis
                  order by md5(patient_id || ':{SEED}'), patient_id) as r,
           count(*) over (partition by cancer_diagnosis) as n from pairs)
select measurement_id, m.patient_id, m.cancer_diagnosis,
       case when r <= ceil(0.4::double * n) then 'test' else 'train' end as part
from measurements m join ranked using (patient_id)""",
)


def split_random(spark, d):
    return split.split_random(adapters.measurements(spark, d), 0.25, SEED).select(
        ID, "part"
    )


RANDOM = with_tables(
    "measurements",
    f"""
select measurement_id,
       case when substr(md5(measurement_id || ':{SEED}'), 1, 8) < '40000000'
            then 'test' else 'train' end as part
from measurements""",
)


def roc_curve(spark, d):
    return evaluate.roc_curve(adapters.scored(spark, d)).select(
        "threshold", tidy("fpr").alias("fpr"), tidy("tpr").alias("tpr")
    )


ROC = """
, steps as (
    select {key} y_score as s, sum(y_true) as p, sum(1 - y_true) as n from {table} group by all)
, cumulated as (
    select *, sum(p) over (partition by {part} order by s desc) as tp,
           sum(n) over (partition by {part} order by s desc) as fp,
           sum(p) over (partition by {part}) as pa, sum(n) over (partition by {part}) as na
    from steps)
, bends as (
    select *, lag(tp) over w as tp0, lag(fp) over w as fp0, lead(tp) over w as tp2,
           lead(fp) over w as fp2
    from cumulated window w as (partition by {part} order by s desc))
, points as (
    select {key} s as threshold, tp, fp, pa, na, tp / pa as tpr, fp / na as fpr from bends
    where tp0 is null or tp2 is null or tp2 - 2 * tp + tp0 <> 0 or fp2 - 2 * fp + fp0 <> 0
    union all
    select distinct {key} 'infinity'::double, 0, 0, pa, na, 0, 0 from cumulated)
"""
ROC_ONE = ROC.format(key="", table="scored", part="1")
ROC_MANY = ROC.format(key="model_id,", table="scored_models", part="model_id")


def optimal_threshold(spark, d):
    points = evaluate.roc_curve(adapters.scored(spark, d))
    rows = []
    for rule, limits in (
        ("free", {}),
        ("sensitivity", {"min_sensitivity": 0.8}),
        ("specificity", {"min_specificity": 0.7}),
        ("both", {"min_sensitivity": 0.6, "min_specificity": 0.99}),
    ):
        best = evaluate.optimal_threshold(points, None, **limits)
        rows.append(
            best.select(
                F.lit(rule).alias("rule"),
                "threshold",
                tidy("tpr").alias("tpr"),
                tidy("fpr").alias("fpr"),
            )
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


OPTIMUM = """
, best as (
    select rule, threshold, tpr, fpr, tp, fp, pa, na, row_number() over (
        partition by rule order by tp * na - fp * pa desc, threshold desc) as rn
    from points, (values ('free', 0.0, 0.0), ('sensitivity', 0.8, 0.0),
                  ('specificity', 0.0, 0.7), ('both', 0.6, 0.0)) r(rule, sens, spec)
    where tpr >= sens and 1 - fpr >= spec)
"""

OPTIMAL = with_tables(
    "scored",
    ROC_ONE
    + OPTIMUM
    + """
select rule, threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr from best where rn = 1""",
)


def roc_metrics(spark, d):
    return evaluate.roc_metrics(adapters.scored(spark, d), min_sensitivity=0.8)


ROC_METRICS = with_tables(
    "scored",
    ROC_ONE
    + OPTIMUM
    + """
, b as (select * from best where rn = 1 and rule = 'sensitivity')
, hit as (
    select sum(case when y_score > threshold then y_true end) as tp,
           sum(case when y_score > threshold then 1 end) as n from scored, b)
select threshold, round_even(tpr * 100, 1) as sensitivity, round_even((1 - fpr) * 100, 1) as specificity,
       round_even(hit.tp / hit.n * 100, 1) as "precision",
       round_even((tpr + 1 - fpr) / 2 * 100, 1) as ba_accuracy
from b, hit""",
)


def roc_auc(spark, d):
    groups = evaluate.score_groups(adapters.scored_models(spark, d), ["model_id"])
    return evaluate.roc_auc(groups, ["model_id"]).select(
        "model_id", tidy("auc").alias("auc")
    )


# The area is the share of (positive, negative) pairs ranked right.
AUC_PAIRS = with_tables(
    "scored_models",
    """
select p.model_id, round(avg(case when p.y_score > n.y_score then 1.0::double
           when p.y_score = n.y_score then 0.5 else 0 end), 6) as auc
from scored_models p join scored_models n on p.model_id = n.model_id
where p.y_true = 1 and n.y_true = 0 group by 1""",
)


def validate(spark, d):
    out = evaluate.validate(adapters.scored(spark, d), min_specificity=0.7)
    return out.withColumn("accuracy", tidy("accuracy"))


VALIDATE = with_tables(
    "scored",
    ROC_ONE
    + OPTIMUM
    + """
, f as (select * from best where rn = 1 and rule = 'free')
, c as (select * from best where rn = 1 and rule = 'specificity')
, acc as (select avg(((y_score > threshold) = (y_true = 1))::int) as accuracy from scored, f)
, hit as (
    select sum(case when y_score > threshold then y_true end)
           / sum(case when y_score > threshold then 1 end) as ppv from scored, c)
, area as (
    select avg(case when p.y_score > n.y_score then 1.0::double
               when p.y_score = n.y_score then 0.5 else 0 end) as auc
    from scored p, scored n where p.y_true = 1 and n.y_true = 0)
select f.threshold as optimal_threshold, round(accuracy, 6) as accuracy,
       round_even(auc * 100, 1) as roc_auc, round_even(c.tpr * 100, 1) as sensitivity,
       round_even((1 - c.fpr) * 100, 1) as specificity, round_even(ppv * 100, 1) as "precision",
       round_even((c.tpr + 1 - c.fpr) / 2 * 100, 1) as ba_accuracy
from f, c, acc, hit, area""",
)


def metrics_f1(spark, d):
    rows = adapters.scored(spark, d).withColumn("patient_id", F.expr("doc_id % 50"))
    return evaluate.youden_summary(rows, "patient_id")


METRICS_F1 = with_tables(
    "scored",
    ROC_ONE
    + OPTIMUM
    + """
, f as (select * from best where rn = 1 and rule = 'free')
, hit as (
    select sum(case when y_score > threshold then y_true end) as tp,
           sum(case when y_score > threshold then 1 end) as n, sum(y_true) as p,
           count(*) as measurements, count(distinct doc_id % 50) as patients from scored, f)
, area as (
    select avg(case when p.y_score > n.y_score then 1.0::double
               when p.y_score = n.y_score then 0.5 else 0 end) as auc
    from scored p, scored n where p.y_true = 1 and n.y_true = 0)
select round_even(auc * 100, 1) as roc_surface, threshold as optimal_threshold,
       round_even(tpr * 100, 1) as sensitivity, round_even((1 - fpr) * 100, 1) as specificity,
       round_even(hit.tp / n * 100, 1) as ppv, round_even(2 * hit.tp / (n + p) * 100, 1) as f1,
       patients, measurements, p::bigint as cancer_measurements,
       (measurements - p)::bigint as control_measurements
from f, hit, area""",
)


def roc_band(spark, d):
    band, extremes = evaluate.roc_band(adapters.scored_models(spark, d))
    return band.select(
        F.lit("mean").alias("kind"),
        "k",
        tidy("fpr").alias("fpr"),
        tidy("mean_tpr").alias("value"),
    ).unionByName(
        extremes.select(
            F.explode(
                F.array(
                    F.struct(F.lit("min_auc").alias("kind"), F.col("min").alias("m")),
                    F.struct(F.lit("max_auc").alias("kind"), F.col("max").alias("m")),
                )
            ).alias("e")
        ).select(
            F.col("e.kind").alias("kind"),
            F.col("e.m.model_id").alias("k"),
            F.lit(None).cast("double").alias("fpr"),
            tidy(F.col("e.m.auc")).alias("value"),
        )
    )


ROC_BAND = with_tables(
    "scored_models",
    ROC_MANY
    + """
, tops as (select model_id, fp, max(tp) as hi, min(tp) as lo, any_value(pa) as pa, any_value(na) as na
           from points group by 1, 2)
, segments as (
    select *, lead(fp) over w as fp2, lead(lo) over w as tp2
    from tops window w as (partition by model_id order by fp))
, on_grid as (
    select k, case when fp2 is null then hi
                   else hi + (k * na / 499.0::double - fp) / (fp2 - fp) * (tp2 - hi) end / pa as tpr
    from segments join range(0, 500) t(k)
         on k * na >= fp * 499 and (fp2 is null or k * na < fp2 * 499))
, areas as (
    select p.model_id, avg(case when p.y_score > n.y_score then 1.0::double
               when p.y_score = n.y_score then 0.5 else 0 end) as auc
    from scored_models p join scored_models n on p.model_id = n.model_id
    where p.y_true = 1 and n.y_true = 0 group by 1)
select 'mean' as kind, k, round(k / 499, 6) as fpr, round(avg(tpr), 6) as value from on_grid group by k
union all
select 'min_auc', arg_min(model_id, (auc, model_id)), null, round(min(auc), 6) from areas
union all
select 'max_auc', arg_max(model_id, (auc, -model_id)), null, round(max(auc), 6) from areas""",
)


def _scored_profiles(spark, d):
    return adapters.profile_arrays(spark, d).withColumns(
        {
            "p1": F.expr("cast(measurement_id % 97 as double) / 97"),
            "p0": F.expr("1 - cast(measurement_id % 97 as double) / 97"),
        }
    )


def patient_features(spark, d):
    rows = _scored_profiles(spark, d)
    out = patients.patient_features(rows, "radial_profile_data")
    return out.select(
        "patient_id",
        F.col("label").cast("int").cast("long").alias("label"),
        *[tidy(c).alias(c) for c in patients.FEATURES],
    )


PATIENTS = """
, kept as (
    select distinct measurement_id, patient_id, type_measurement as t, cancer_diagnosis, age
    from profiles)
, far as (
    select a.patient_id, a.type_measurement as t, a.measurement_id as i, b.measurement_id as j,
           sqrt(sum((a.intensity - b.intensity) ** 2)) as dist
    from profiles a join profiles b
      on a.patient_id = b.patient_id and a.type_measurement = b.type_measurement
         and a.pos = b.pos and a.measurement_id < b.measurement_id
    group by all)
, means as (select patient_id, t, avg(dist) as m from far group by 1, 2)
"""

PATIENT_FEATURES = with_tables(
    "profiles",
    PATIENTS
    + """
, base as (
    select patient_id, arg_min(cancer_diagnosis, measurement_id)::bigint as label,
           avg(case when t = 'SAXS' then 1 - (measurement_id % 97) / 97.0::double end) as s0,
           avg(case when t = 'SAXS' then (measurement_id % 97) / 97.0::double end) as s1,
           avg(case when t = 'WAXS' then 1 - (measurement_id % 97) / 97.0::double end) as w0,
           avg(case when t = 'WAXS' then (measurement_id % 97) / 97.0::double end) as w1,
           count(case when t = 'SAXS' then 1 end) as ns, count(case when t = 'WAXS' then 1 end) as nw,
           min(case when t = 'SAXS' then measurement_id end) as first_saxs
    from kept group by 1)
select b.patient_id, label, round(coalesce(s0, -1), 6) as saxs_p0, round(coalesce(s1, -1), 6) as saxs_p1,
       round(coalesce(w0, -1), 6) as waxs_p0, round(coalesce(w1, -1), 6) as waxs_p1,
       case when ns = 0 then 0 else round(1 / ns, 6) end as saxs_share,
       case when nw = 0 then 0 else round(1 / nw, 6) end as waxs_share,
       case when ns = 0 then -1 else round(s.m, 6) end as saxs_distance,
       case when nw = 0 then -1 else round(w.m, 6) end as waxs_distance,
       case when ns = 0 then -1 else round(1 / k.age, 6) end as age_inverse
from base b left join kept k on k.measurement_id = b.first_saxs
     left join means s on s.patient_id = b.patient_id and s.t = 'SAXS'
     left join means w on w.patient_id = b.patient_id and w.t = 'WAXS'""",
)


def pairwise_mean_distance(spark, d):
    """Blocks far smaller than the default, so that groups span several."""
    out = patients.pairwise_mean_distance(
        adapters.profile_arrays(spark, d),
        ["patient_id", "type_measurement"],
        "radial_profile_data",
        block=5,
    )
    return out.select(
        "patient_id",
        "type_measurement",
        F.col("n").cast("long").alias("n"),
        tidy("mean_distance").alias("mean_distance"),
    )


PAIRWISE = with_tables(
    "profiles",
    PATIENTS
    + """
, n as (select patient_id, type_measurement as t, count(distinct measurement_id) as n
        from profiles group by 1, 2)
select patient_id, t as type_measurement, n, round(m, 6) as mean_distance
from n left join means using (patient_id, t)""",
)


def _clustered(spark, d):
    return adapters.measurements(spark, d).select(
        ID,
        F.expr("patient_id % 50").alias(cluster.LABEL),
        F.col("raw_score").alias("q_range_max"),
    )


def _outliers(direction, threshold):
    def run(spark, d):
        rows = cluster.remove_outliers(_clustered(spark, d), threshold, direction)
        return rows.select(ID, cluster.LABEL, "q_range_max")

    return run


def _outliers_sql(test: str) -> str:
    return with_tables(
        "measurements",
        f"""
, z as (
    select measurement_id, patient_id % 50 as q_cluster_label, raw_score as q_range_max,
           (raw_score - avg(raw_score) over (partition by patient_id % 50))
           / stddev_pop(raw_score) over (partition by patient_id % 50) as z
    from measurements)
select measurement_id, q_cluster_label, q_range_max from z where {test}""",
    )


def clusterize(spark, d):
    """Three groups of q ranges; labels are put in the order of the ranges."""
    rows = adapters.profile_arrays(spark, d).withColumn(
        "q_range", F.transform("q_range", lambda q: q * (1 + F.col("label") % 3))
    )
    out = cluster.clusterize(rows, 3)
    lowest = out.groupBy(cluster.LABEL).agg(F.min("q_range_max").alias("low"))
    ordered = out.join(lowest, cluster.LABEL)
    return ordered.select(
        ID,
        tidy("q_range_min").alias("q_range_min"),
        tidy("q_range_max").alias("q_range_max"),
        tidy("low").alias("cluster_start"),
    )


CLUSTERIZE = with_tables(
    "profiles",
    """
select measurement_id, round(min(q) * (1 + any_value(label) % 3), 6) as q_range_min,
       round(max(q) * (1 + any_value(label) % 3), 6) as q_range_max,
       round(max(q) * (1 + any_value(label) % 3), 6) as cluster_start
from profiles group by 1""",
)


def cluster_q_range(spark, d):
    out = cluster.cluster_q_range(_clustered(spark, d), 0.1, 0.9)
    return out.select(
        ID,
        cluster.LABEL,
        tidy("interpolation_q_range.q_min").alias("q_min"),
        tidy("interpolation_q_range.q_max").alias("q_max"),
    )


CLUSTER_Q_RANGE = with_tables(
    "measurements",
    """
select measurement_id, patient_id % 50 as q_cluster_label,
       round(min(raw_score) over (partition by patient_id % 50) * 0.1::double, 6) as q_min,
       round(min(raw_score) over (partition by patient_id % 50) * 0.9::double, 6) as q_max
from measurements""",
)


def cluster_norm_scale(spark, d):
    df = cluster.cluster_norm_scale(
        adapters.profile_arrays(spark, d).withColumnRenamed("label", cluster.LABEL)
    )
    return df.select(
        ID, cluster.LABEL, F.posexplode(scale.SCALED).alias("pos", "scaled")
    ).select(
        ID,
        cluster.LABEL,
        F.col("pos").cast("long").alias("pos"),
        tidy("scaled").alias("scaled"),
    )


QUERIES = {
    "split_patient_balanced": (split_patient_balanced, BALANCED),
    "split_stratified_patients": (split_stratified_patients, STRATIFIED),
    "split_random": (split_random, RANDOM),
    "roc_curve": (
        roc_curve,
        with_tables(
            "scored",
            ROC_ONE
            + "select threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from points",
        ),
    ),
    "optimal_threshold": (optimal_threshold, OPTIMAL),
    "roc_metrics": (roc_metrics, ROC_METRICS),
    "roc_auc": (roc_auc, AUC_PAIRS),
    "validate": (validate, VALIDATE),
    "metrics_f1": (metrics_f1, METRICS_F1),
    "roc_band": (roc_band, ROC_BAND),
    "patient_features": (patient_features, PATIENT_FEATURES),
    "pairwise_mean_distance": (pairwise_mean_distance, PAIRWISE),
    "outliers_zscore": (_outliers("both", 1.5), _outliers_sql("abs(z) <= 1.5")),
    "outliers_zscore_positive": (_outliers("positive", 1.0), _outliers_sql("z <= 1")),
    "outliers_zscore_negative": (_outliers("negative", 1.0), _outliers_sql("z >= -1")),
    "clusterize": (clusterize, CLUSTERIZE),
    "cluster_q_range": (cluster_q_range, CLUSTER_Q_RANGE),
    "cluster_norm_scale": (
        cluster_norm_scale,
        with_tables(
            "profiles",
            NORM_SCALE.format(by="label")
            + """select measurement_id, label as q_cluster_label, pos,
                        round(scaled, 6) + 0.0 as scaled from scaled""",
        ),
    ),
}
