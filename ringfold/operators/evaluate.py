"""Receiver operating characteristic and the metrics read off it.

Scores are first combined into one row per distinct score, so a score shared by
many rows is a single row before anything is ordered. The order is walked in
buckets of the score range instead of one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written

Y, S = "y_true", "y_score"
BUCKETS = 256


def wide(count: Column | str) -> Column:
    """A count that can be multiplied by another without overflow."""
    return (F.col(count) if isinstance(count, str) else count).cast("decimal(19,0)")


def score_groups(
    scored: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """One row per distinct score with its counts, the counts of all higher
    scores (``pos_above``, ``neg_above``), of the next lower score, and totals.

    Buckets lie between approximate quantiles of each key's own scores. Both the
    bucketed scores and the result are written once, as all metrics read them.
    """
    keys = keys or []
    is_pos = F.col(Y).cast("int")
    counted = written(
        scored.groupBy(*keys, S).agg(
            F.sum(is_pos).cast("long").alias("pos"),
            F.sum(1 - is_pos).cast("long").alias("neg"),
        ),
        "scores",
    )
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)]).cast("array<double>")
    edges = (
        F.percentile_approx(S, shares, 4 * buckets)
        if buckets > 1
        else F.array().cast("array<double>")
    )
    found = counted.groupBy(*keys).agg(edges.alias("_edges"))
    told = (
        counted.join(found, keys)
        if keys
        else counted.withColumn("_edges", found.scalar())
    )
    higher = F.transform(
        F.array(F.col(S)), lambda s: F.size(F.filter("_edges", lambda e: e > s))
    )[0]
    groups = written(told.withColumn("_bucket", higher).drop("_edges"), "buckets")
    heads = groups.groupBy(*keys, "_bucket").agg(
        F.sum("pos").alias("_bp"),
        F.sum("neg").alias("_bn"),
        F.max_by(F.struct("pos", "neg"), S).alias("_head"),
    )
    everyone = Window.partitionBy(*keys, F.lit(0))
    in_order = everyone.orderBy("_bucket")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0"),
        F.lead("_head").over(in_order).alias("_next_head"),
        F.sum("_bp").over(everyone).alias("p_all"),
        F.sum("_bn").over(everyone).alias("n_all"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(S))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    joined = groups.join(heads, [*keys, "_bucket"])
    return written(
        joined.select(
            *keys,
            F.col(S).alias("threshold"),
            "pos",
            "neg",
            (F.col("_p0") + F.coalesce(F.sum("pos").over(earlier), zero)).alias(
                "pos_above"
            ),
            (F.col("_n0") + F.coalesce(F.sum("neg").over(earlier), zero)).alias(
                "neg_above"
            ),
            F.coalesce(
                F.lead(F.struct("pos", "neg")).over(inside), F.col("_next_head")
            ).alias("next"),
            "p_all",
            "n_all",
        ),
        "roc",
    )


def roc_points(
    groups: DataFrame, keys: list[str] | None = None, drop_intermediate: bool = True
) -> DataFrame:
    """Curve points as counts ``tp``, ``fp`` at each threshold (score >= it).

    Starts at (0, 0) with an infinite threshold. A point between two equal
    steps lies on a line and is dropped; the first and last are kept.
    """
    keys = keys or []
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    first = (F.col("pos_above") == 0) & (F.col("neg_above") == 0)
    bend = (
        F.col("next").isNull()
        | first
        | (F.col("next.pos") != F.col("pos"))
        | (F.col("next.neg") != F.col("neg"))
    )
    kept = groups.filter(bend) if drop_intermediate else groups
    points = kept.select(
        *keys, "threshold", tp.alias("tp"), fp.alias("fp"), "p_all", "n_all"
    )
    start = groups.groupBy(*keys).agg(
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"),
        F.max("p_all").alias("p_all"),
        F.max("n_all").alias("n_all"),
    )
    return points.unionByName(start).withColumns(
        {
            "tpr": F.try_divide("tp", "p_all"),
            "fpr": F.try_divide("fp", "n_all"),
        }
    )


def roc_curve(
    scored: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    return roc_points(score_groups(scored, keys, buckets), keys)


def optimal_threshold(
    points: DataFrame,
    keys: list[str] | None = None,
    min_sensitivity: float | None = None,
    min_specificity: float | None = None,
) -> DataFrame:
    """The first point, from the highest threshold, with the largest tpr - fpr,
    compared in whole counts. A sensitivity bound shadows a specificity bound."""
    keys = keys or []
    if min_sensitivity is not None:
        points = points.filter(F.col("tpr") >= float(min_sensitivity))
    elif min_specificity is not None:
        points = points.filter(1 - F.col("fpr") >= float(min_specificity))
    gain = wide("tp") * wide("n_all") - wide("fp") * wide("p_all")
    best = F.max_by(
        F.struct("threshold", "tp", "fp", "p_all", "n_all", "tpr", "fpr"),
        F.struct(gain, F.col("threshold")),
    )
    return points.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def percent(share: Column) -> Column:
    """Percent with one decimal, exact halves to even."""
    return F.bround(share * 100, 1)


def confusion_above(
    groups: DataFrame, optimum: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Counts predicted positive (score strictly above the optimum), by class.
    The optimum has one row per key and enters a global result as a scalar."""
    keys = keys or []
    if keys:
        rows = groups.join(
            optimum.select(*keys, F.col("threshold").alias("_t")), keys
        )
    else:
        rows = groups.withColumn("_t", optimum.select("threshold").scalar())
    above = F.col("threshold") > F.col("_t")
    return rows.groupBy(*keys).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp_pred"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp_pred"),
        F.max("p_all").alias("p_all"),
        F.max("n_all").alias("n_all"),
    )


def roc_auc(groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area by trapezoids: each distinct score adds its own."""
    keys = keys or []
    twice = wide("neg") * wide(2 * wide("pos_above") + wide("pos"))
    pairs = wide(F.max("p_all")) * wide(F.max("n_all"))
    return groups.groupBy(*keys).agg(
        F.try_divide(F.sum(twice).cast("double") / 2, pairs.cast("double")).alias("auc")
    )


def _one_row(frames: dict[str, DataFrame], spark) -> DataFrame:
    """Assemble one-row results as scalar subqueries."""
    row = spark.range(1)
    for name, frame in frames.items():
        row = row.withColumn(name, frame.select(F.struct(*frame.columns)).scalar())
    return row


def roc_metrics(
    scored: DataFrame,
    min_sensitivity: float | None = None,
    min_specificity: float | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Sensitivity, specificity, precision and balanced accuracy in percent at
    the optimum. Rates count scores at or above it, precision those above."""
    groups = score_groups(scored) if groups is None else groups
    best = optimal_threshold(
        roc_points(groups), None, min_sensitivity, min_specificity
    )
    row = _one_row(
        {"best": best, "hit": confusion_above(groups, best)}, scored.sparkSession
    )
    tpr, fpr = F.col("best.tpr"), F.col("best.fpr")
    predicted = F.col("hit.tp_pred") + F.col("hit.fp_pred")
    precision = F.coalesce(F.try_divide("hit.tp_pred", predicted), F.lit(0.0))
    return row.select(
        F.col("best.threshold").alias("threshold"),
        percent(tpr).alias("sensitivity"),
        percent(1 - fpr).alias("specificity"),
        percent(precision).alias("precision"),
        percent((tpr + 1 - fpr) / 2).alias("ba_accuracy"),
    )


def validate(
    scored: DataFrame,
    metrics: tuple[str, ...] = ("accuracy", "roc_auc"),
    min_sensitivity: float | None = None,
    min_specificity: float | None = None,
) -> DataFrame:
    """One row. Accuracy is a fraction at the unconstrained optimum; the ROC
    metrics are percentages at the constrained one."""
    groups = score_groups(scored)
    best = optimal_threshold(roc_points(groups))
    parts = {"best": best}
    if "accuracy" in metrics:
        parts["hit"] = confusion_above(groups, best)
    if "roc_auc" in metrics:
        parts["auc"] = roc_auc(groups)
        parts["roc"] = roc_metrics(scored, min_sensitivity, min_specificity, groups)
    row = _one_row(parts, scored.sparkSession)
    out = [F.col("best.threshold").alias("optimal_threshold")]
    if "accuracy" in metrics:
        right = F.col("hit.tp_pred") + F.col("hit.n_all") - F.col("hit.fp_pred")
        out.append((right / (F.col("hit.p_all") + F.col("hit.n_all"))).alias("accuracy"))
    if "roc_auc" in metrics:
        out.append(percent(F.col("auc.auc")).alias("roc_auc"))
        out += [
            F.col(f"roc.{c}").alias(c)
            for c in ("sensitivity", "specificity", "precision", "ba_accuracy")
        ]
    return row.select(*out)


def youden_summary(scored: DataFrame, patient: str | None = None) -> DataFrame:
    """AUC, threshold, sensitivity, specificity, precision and F1 at the
    optimum, with the sizes of the scored set."""
    groups = score_groups(scored)
    best = optimal_threshold(roc_points(groups))
    sizes = scored.agg(
        F.count(F.lit(1)).alias("measurements"),
        F.sum(F.col(Y).cast("int")).alias("cancer_measurements"),
        (
            F.count_distinct(patient) if patient else F.lit(None).cast("long")
        ).alias("patients"),
    )
    row = _one_row(
        {
            "best": best,
            "hit": confusion_above(groups, best),
            "auc": roc_auc(groups),
            "size": sizes,
        },
        scored.sparkSession,
    )
    tp, fp = F.col("hit.tp_pred"), F.col("hit.fp_pred")
    zero = F.lit(0.0)
    return row.select(
        percent(F.col("auc.auc")).alias("roc_surface"),
        F.col("best.threshold").alias("optimal_threshold"),
        percent(F.col("best.tpr")).alias("sensitivity"),
        percent(1 - F.col("best.fpr")).alias("specificity"),
        percent(F.coalesce(F.try_divide(tp, tp + fp), zero)).alias("ppv"),
        percent(
            F.coalesce(F.try_divide(2 * tp, tp + fp + F.col("hit.p_all")), zero)
        ).alias("f1"),
        F.col("size.patients").alias("patients"),
        F.col("size.measurements").alias("measurements"),
        F.col("size.cancer_measurements").alias("cancer_measurements"),
        (F.col("size.measurements") - F.col("size.cancer_measurements")).alias(
            "control_measurements"
        ),
    )


def roc_band(
    scored: DataFrame, model: str = "model_id", grid: int = 500
) -> tuple[DataFrame, DataFrame]:
    """(band, extremes) of many models: mean tpr on an even fpr grid, and the
    models of smallest and largest AUC (the smaller id wins a tie).

    Each segment of a curve emits the grid points it covers, so a model yields
    ``grid`` rows and no range join is needed. At a vertical step the upper end
    counts.
    """
    groups = score_groups(scored, [model])
    points = roc_points(groups, [model])
    # segments follow the count order; a model's curve is walked per fp count
    tops = points.groupBy(model, "fp").agg(
        F.max("tp").alias("tp_top"),
        F.min("tp").alias("tp_low"),
        F.max("p_all").alias("p_all"),
        F.max("n_all").alias("n_all"),
    )
    segments = _segments(tops, model, grid)
    last = grid - 1
    x = F.col("k") / float(last)
    share = (x * F.col("n_all") - F.col("fp")) / (F.col("fp_next") - F.col("fp"))
    tpr = (
        F.when(F.col("fp_next").isNull(), F.col("tp_top"))
        .otherwise(F.col("tp_top") + share * (F.col("tp_next") - F.col("tp_top")))
        / F.col("p_all")
    )
    band = (
        segments.withColumn("tpr", tpr)
        .groupBy("k")
        .agg(F.avg("tpr").alias("mean_tpr"))
        .select("k", (F.col("k") / float(last)).alias("fpr"), "mean_tpr")
    )
    auc = roc_auc(groups, [model])
    extremes = auc.agg(
        F.min_by(F.struct(model, "auc"), F.struct("auc", model)).alias("min"),
        F.max_by(F.struct(model, "auc"), F.struct(F.col("auc"), -F.col(model))).alias(
            "max"
        ),
    )
    return band, extremes


def _segments(tops: DataFrame, model: str, grid: int) -> DataFrame:
    """Curve steps joined to the next step, exploded to the grid points in
    [this, next). The next step is found per bucket of the fp axis: one bucket
    per grid cell, so a bucket holds the points between two grid lines."""
    last = grid - 1
    cell = F.floor(F.col("fp") * last / F.col("n_all"))
    rows = tops.withColumn("_cell", cell)
    heads = rows.groupBy(model, "_cell").agg(
        F.min_by(
            F.struct(F.col("fp").alias("fp"), F.col("tp_low").alias("tp")), "fp"
        ).alias("_head")
    )
    over = Window.partitionBy(model).orderBy("_cell")
    heads = heads.select(model, "_cell", F.lead("_head").over(over).alias("_next"))
    inside = Window.partitionBy(model, "_cell").orderBy("fp")
    joined = rows.join(heads, [model, "_cell"]).withColumn(
        "_after",
        F.coalesce(
            F.lead(F.struct(F.col("fp").alias("fp"), F.col("tp_low").alias("tp"))).over(
                inside
            ),
            F.col("_next"),
        ),
    )

    def first_at(fp: Column) -> Column:
        return F.ceil(fp * last / F.col("n_all")).cast("long")

    joined = joined.withColumns(
        {
            "fp_next": F.col("_after.fp"),
            "tp_next": F.col("_after.tp"),
            "_from": first_at(F.col("fp")),
        }
    ).withColumn(
        "_to",
        F.coalesce(first_at(F.col("fp_next")) - 1, F.lit(last).cast("long")),
    )
    return joined.filter(F.col("_from") <= F.col("_to")).select(
        model,
        "fp",
        "tp_top",
        "fp_next",
        "tp_next",
        "p_all",
        "n_all",
        F.explode(F.sequence("_from", "_to")).alias("k"),
    )
