"""Features of patients from the scores and profiles of their measurements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import attach
from .integrate import ID

BLOCK = 1024
# A group has at most so many blocks while they have at most so many rows.
BLOCKS, LARGEST = 16, 4096
# Distances worked out at once.
CHUNK = 1 << 16
FEATURES = [
    "saxs_p0",
    "saxs_p1",
    "waxs_p0",
    "waxs_p1",
    "saxs_share",
    "waxs_share",
    "saxs_distance",
    "waxs_distance",
    "age_inverse",
]


def distance_sum(low: np.ndarray, high: np.ndarray | None = None) -> float:
    """Sum of the Euclidean distances of all rows of ``low`` to all of ``high``, or
    over the unordered pairs of ``low`` alone.

    Squares come from one matrix product for many pairs; those of close pairs,
    where that would lose digits, from their differences.
    """
    own, high = high is None, low if high is None else high
    if not len(low) or not len(high):
        return 0.0
    total = 0.0
    if not (np.isfinite(low).all() and np.isfinite(high).all()):
        for i, point in enumerate(low):
            others = high[i + 1 :] if own else high
            total += float(np.sqrt(((others - point) ** 2).sum(axis=1)).sum())
        return total
    center = high.mean(axis=0)
    low, high = low - center, high - center
    sizes = (high * high).sum(axis=1)
    step = max(1, CHUNK // len(high))
    for i in range(0, len(low), step):
        part = low[i : i + step]
        both = (part * part).sum(axis=1)[:, None] + sizes
        squares = both - 2 * (part @ high.T)
        r, c = np.nonzero(squares <= 1e-4 * both)
        squares[r, c] = ((part[r] - high[c]) ** 2).sum(axis=1)
        total += float(np.sqrt(squares).sum())
    return total / 2 if own else total


def block_count(n: Column, block: int) -> Column:
    """Blocks of at least about ``block`` rows for a group of ``n`` rows."""
    length = F.greatest(F.lit(float(block)), F.least(F.lit(float(LARGEST)), n / float(BLOCKS)))
    return F.ceil(n / length).cast("int")


def pairwise_mean_distance(
    df: DataFrame, keys: list[str], vector: str, block: int = BLOCK
) -> DataFrame:
    """Mean Euclidean distance over unordered pairs within each group.

    A group is cut into blocks of at least about ``block`` rows and every pair of
    blocks is one task-sized unit that returns one number, so neither a large group
    nor its pairs ever meet in one place. A row is sent once per block of its
    group; blocks of large groups are therefore longer, up to ``LARGEST`` rows.
    A single row has no pairs: null. Blocks follow a hash of ``measurement_id``,
    which must be unique.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = attach(
        df.select(*keys, ID, vector),
        sizes.withColumn("_blocks", block_count(F.col("n"), block)),
        keys,
        [ID],
    )
    rows = rows.withColumn(
        "_mine", F.pmod(F.xxhash64(ID), F.col("_blocks")).cast("int")
    ).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    units = rows.select(
        *keys,
        F.least("_mine", "_other").alias("_lo"),
        F.greatest("_mine", "_other").alias("_hi"),
        "_mine",
        vector,
    )

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        low = np.array(pdf.loc[pdf["_mine"] == lo, vector].to_list(), dtype=float)
        high = None if lo == hi else np.array(pdf.loc[pdf["_mine"] == hi, vector].to_list(), dtype=float)
        total = distance_sum(low, high)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "part": [total]})

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", part double"
    parts = (
        units.groupBy(*keys, "_lo", "_hi")
        .applyInPandas(unit, schema)
        .groupBy(*keys)
        .agg(F.sum("part").alias("total"))
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(parts, keys).select(
        *keys, "n", F.try_divide(F.col("total"), pairs).alias("mean_distance")
    )


def patient_features(
    scored: DataFrame, vector: str | None = None, label: str | None = "cancer_diagnosis"
) -> DataFrame:
    """One row per patient: mean class probabilities (``p0``, ``p1``) of SAXS and
    WAXS rows (-1 without any), 1/count (0 without any), mean pairwise distance
    (-1 without any, null for a single row) and 1/age of the first SAXS row
    (age -1 without any). Rows are ordered by measurement id."""
    aggregates = []
    for kind in ("SAXS", "WAXS"):
        name = kind.lower()
        here = F.col("type_measurement") == kind
        aggregates += [
            F.count(F.when(here, 1)).alias(f"_n_{name}"),
            F.avg(F.when(here, F.col("p0"))).alias(f"_p0_{name}"),
            F.avg(F.when(here, F.col("p1"))).alias(f"_p1_{name}"),
        ]
    first_saxs = F.when(F.col("type_measurement") == "SAXS", F.col(ID))
    aggregates.append(F.min_by(F.struct("age"), first_saxs).alias("_age"))
    if label:
        aggregates.append(F.min_by(label, ID).alias("label"))
    wide = scored.groupBy("patient_id").agg(*aggregates)
    columns = []
    for kind in ("saxs", "waxs"):
        for p in ("p0", "p1"):
            columns.append(
                F.coalesce(f"_{p}_{kind}", F.lit(-1.0)).alias(f"{kind}_{p}")
            )
    for kind in ("saxs", "waxs"):
        columns.append(
            F.coalesce(F.try_divide(F.lit(1.0), F.col(f"_n_{kind}")), F.lit(0.0)).alias(
                f"{kind}_share"
            )
        )
    age = F.when(F.col("_age").isNull(), F.lit(-1.0)).otherwise(
        F.col("_age.age").cast("double")
    )
    columns.append(F.try_divide(F.lit(1.0), age).alias("age_inverse"))
    if label:
        columns.append(F.col("label"))
    out = wide.select("patient_id", *[f"_n_{k}" for k in ("saxs", "waxs")], *columns)
    if vector:
        far = pairwise_mean_distance(scored, ["patient_id", "type_measurement"], vector)
        far = far.groupBy("patient_id").agg(
            *[
                F.max(
                    F.when(F.col("type_measurement") == k, F.col("mean_distance"))
                ).alias(f"_d_{k.lower()}")
                for k in ("SAXS", "WAXS")
            ]
        )
        out = out.join(far, "patient_id", "left")
        for k in ("saxs", "waxs"):
            out = out.withColumn(
                f"{k}_distance",
                F.when(F.col(f"_n_{k}") == 0, -1.0).otherwise(F.col(f"_d_{k}")),
            )
        out = out.drop("_d_saxs", "_d_waxs")
    return out.drop("_n_saxs", "_n_waxs")
