"""Reproducible splits. The order of a shuffle is a hash text of the key, so a
split depends neither on partitioning nor on a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import attach, hash_bucket, hash_order, running_total

ID = "measurement_id"


def split_random(
    df: DataFrame, test_size: float = 0.25, seed: int = 0, key: str = ID
) -> DataFrame:
    """Add ``part`` (train or test): a row is test when its hash falls in the
    leading ``test_size`` of the hash range."""
    limit = f"{min(int(test_size * 16**8), 16**8 - 1):08x}"
    is_test = F.substring(hash_order(F.col(key), seed), 1, 8) < limit
    return df.withColumn("part", F.when(is_test, "test").otherwise("train"))


def split_patient_balanced(
    df: DataFrame, split: float, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(train, test) whose patients never straddle.

    Each class has a quota of rows for training in proportion to its share. Its
    patients are taken in hash order while the rows taken before do not exceed
    the quota; a patient taken for either class is a training patient.
    """
    sizes = df.groupBy("patient_id", "cancer_diagnosis").agg(
        F.count(F.lit(1)).alias("_n")
    ).filter(F.col("cancer_diagnosis").isNotNull())
    order = hash_order(F.col("patient_id"), seed)
    ranked = running_total(
        sizes.withColumn("_order", order),
        ["cancer_diagnosis"],
        hash_bucket(F.col("_order")),
        [F.col("_order"), F.col("patient_id")],
        {"_before": "_n"},
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    train_size = F.floor(F.lit(1 - split) * total)
    quota = F.floor(train_size * (F.col("_before_all") / total))
    taken = (
        ranked.filter(F.col("_before") <= quota).select("patient_id").distinct()
    )
    return _members(df, taken)


def _members(df: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed patients, and the rest. A patient may own many rows,
    so rows are marked by a spread join instead of shuffling on the patient."""
    marked = attach(df, patients.withColumn("_in", F.lit(True)), ["patient_id"], [ID], "left")
    return (
        marked.filter(F.col("_in").isNotNull()).drop("_in"),
        marked.filter(F.col("_in").isNull()).drop("_in"),
    )


def split_stratified_patients(
    df: DataFrame, split: float = 0.4, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by distinct (patient, diagnosis), stratified: the first
    ceil(split * n) of each stratum in hash order are test patients. A patient
    listed under both diagnoses may be in both parts."""
    pairs = df.select("patient_id", "cancer_diagnosis").distinct()
    ranked = running_total(
        pairs.withColumns(
            {"_order": hash_order(F.col("patient_id"), seed), "_one": F.lit(1)}
        ),
        ["cancer_diagnosis"],
        hash_bucket(F.col("_order")),
        [F.col("_order"), F.col("patient_id")],
        {"_rank": "_one"},
    )
    is_test = F.col("_rank") < F.ceil(F.lit(split) * F.col("_rank_all"))
    train_patients = ranked.filter(~is_test).select("patient_id").distinct()
    test_patients = ranked.filter(is_test).select("patient_id").distinct()
    return _members(df, train_patients)[0], _members(df, test_patients)[0]


def marked(train: DataFrame, test: DataFrame, *columns: str | Column) -> DataFrame:
    """Both parts in one frame with a ``part`` column."""
    return train.select(*columns, F.lit("train").alias("part")).unionByName(
        test.select(*columns, F.lit("test").alias("part"))
    )
