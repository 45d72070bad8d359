"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


# Copies of a stats row that cannot be broadcast. A fixed number, so that what is
# shuffled grows with the rows and not with the number of partitions as well.
SALTS = 8


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate; of a plain table, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcastable(df: DataFrame) -> bool:
    """Whether the planner's own estimate lets it broadcast ``df`` as it is."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(df) <= limit


def parts_for(df: DataFrame, amount: int, of_one: int) -> int:
    """Partitions of at most ``of_one`` of the ``amount``, at least one per core.

    Given as a number, partitions are not merged again: adaptive execution does that
    by compressed bytes, and says nothing of what an aggregation then holds."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-amount // of_one))


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join per-key ``stats`` (one row per key) back to the many ``rows``.

    Stats that the planner may broadcast are joined as they are. Else the rows of
    one key are spread over ``salts`` partitions by a hash of the ``spread`` columns
    and the stats row is repeated for each. The salt is part of the join key, so a
    later grouping on ``keys`` plans its own exchange and adaptive execution is free
    to split what is still too large. The planner's estimates do not count the
    copies, so a join with them is said to be a merge: a broadcast would hold
    ``salts`` times what was estimated.
    """
    if salts < 2 or broadcastable(stats):
        return rows.join(stats, keys, how)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    right = stats.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))),
    )
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    sums: dict[str, str],
) -> DataFrame:
    """Exclusive running totals in a global order, without a global window.

    ``bucket`` must be non-decreasing in the order and take few values (the
    callers use at most 4,096). Bucket totals are prefix-summed on their own,
    then each bucket is scanned in its own partition. ``sums`` maps each output
    column to the column it accumulates; the total per key is returned as
    ``<output>_all``.
    """
    df = df.withColumn("_bucket", bucket)
    per_bucket = df.groupBy(*keys, "_bucket").agg(
        *[F.sum(src).alias(f"_b_{out}") for out, src in sums.items()]
    )
    over_keys = Window.partitionBy(*keys, F.lit(0))
    before = over_keys.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_bucket = per_bucket.select(
        *keys,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_b_{out}").over(before), F.lit(0)).alias(f"_p_{out}")
            for out in sums
        ],
        *[F.sum(f"_b_{out}").over(over_keys).alias(f"{out}_all") for out in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = df.join(per_bucket, [*keys, "_bucket"])
    return joined.select(
        *df.drop("_bucket").columns,
        *[
            (
                F.col(f"_p_{out}")
                + F.coalesce(F.sum(src).over(inside), F.lit(0))
            ).alias(out)
            for out, src in sums.items()
        ],
        *[f"{out}_all" for out in sums],
    )


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle: order by this text instead of drawing numbers."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_bucket(order: Column, digits: int = 3) -> Column:
    """Leading hex digits: an order-preserving bucket of ``hash_order``."""
    return F.substring(order, 1, digits)
