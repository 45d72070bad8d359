"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, alias: str = "_row") -> Column:
    """The whole input row as one struct, out of the way of working columns."""
    return F.struct(*[named(c) for c in df.columns]).alias(alias)


def unpacked(columns: list[str], added: list[str], alias: str = "_row") -> list[Column]:
    """The packed columns again, but those that an added column replaces."""
    taken = {c.lower() for c in added}
    return [
        F.col(alias).getField(c).alias(c) for c in columns if c.lower() not in taken
    ]


def crc32_mod(key: Column, parts: int) -> Column:
    """Fold number of a key: crc32 of its decimal text."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
