"""Clusters of measurements by q range, and cleaning within them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.skew import attach
from .integrate import ID
from .scale import norm_scale

LABEL = "q_cluster_label"


def _spread(df: DataFrame) -> list[str]:
    """Columns that tell rows of one cluster apart."""
    if ID in df.columns:
        return [ID]
    return [c for c, kind in df.dtypes if not kind.startswith("map")]


def remove_outliers(
    df: DataFrame,
    threshold: float = 3.0,
    direction: str = "both",
    label: str = LABEL,
    column: str = "q_range_max",
) -> DataFrame:
    """Drop rows whose z-score within their cluster exceeds the threshold."""
    if direction not in {"both", "positive", "negative"}:
        # fixed value: the message for an unknown direction
        raise ValueError("Invalid direction. Use 'both', 'positive', or 'negative'.")
    stats = df.groupBy(label).agg(
        F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std")
    )
    rows = attach(df, stats, [label], _spread(df))
    z = F.coalesce(F.try_divide(F.col(column) - F.col("_mean"), F.col("_std")), F.lit(0.0))
    keep = {
        "both": F.abs(z) <= threshold,
        "positive": z <= threshold,
        "negative": z >= -threshold,
    }[direction]
    return rows.filter(keep).drop("_mean", "_std")


def clusterize(df: DataFrame, n_clusters: int, seed: int = 0) -> DataFrame:
    """Add q_range_min, q_range_max and a cluster label by k-means on both."""
    rows = df.withColumns(
        {
            "q_range_min": F.array_min("q_range").cast("double"),
            "q_range_max": F.array_max("q_range").cast("double"),
        }
    ).withColumn("_v", array_to_vector(F.array("q_range_min", "q_range_max")))
    model = KMeans(
        k=n_clusters, seed=seed, featuresCol="_v", predictionCol=LABEL
    ).fit(rows)
    return model.transform(rows).drop("_v")


def cluster_q_range(
    df: DataFrame, perc_min: float, perc_max: float, label: str = LABEL
) -> DataFrame:
    """interpolation_q_range = shares of the smallest q_range_max in the cluster."""
    lowest = df.groupBy(label).agg(F.min("q_range_max").alias("_low"))
    rows = attach(df, lowest, [label], _spread(df))
    return rows.withColumn(
        "interpolation_q_range",
        F.struct(
            (F.col("_low") * perc_min).alias("q_min"),
            (F.col("_low") * perc_max).alias("q_max"),
        ),
    ).drop("_low")


def cluster_norm_scale(df: DataFrame, label: str = LABEL) -> DataFrame:
    """L1 norm and a separate scaler for each cluster."""
    return norm_scale(df, by=label)

