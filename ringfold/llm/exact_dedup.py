"""Exact duplicates by two passes over a Bloom filter.

Pass one counts, for every text, the cells of a Bloom filter that its hash
falls on, and keeps the cells hit twice or more. Pass two asks that filter: a
text with a cell hit once cannot have an equal and passes straight through;
only the possibly repeated rows shuffle, and they are compared by SHA-256.

The filter has 16 cells a row up to ``MAX_BITS`` (32 MB as it is broadcast).
Beyond about 16 million rows it fills up: more rows shuffle for nothing, the
result stays exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written
from .common import packed, unpacked

MAX_BITS = 1 << 28
CELLS_PER_ROW = 16
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    plain = F.coalesce(text, F.lit(""))
    for other in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    return F.sha2(F.regexp_replace(plain, " {2,}", " "), 256)


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Cells of the filter: a power of two, at least one 64-bit word."""
    return min(max_bits, 1 << max(6, (CELLS_PER_ROW * max(rows, 1) - 1).bit_length()))


def cells(key: Column, bits: int) -> Column:
    """The two cells of a 64-bit hash; they always differ."""
    first = key.bitwiseAND(F.lit(bits - 1))
    step = F.shiftrightunsigned(key, 34).bitwiseAND(F.lit(bits // 2 - 1)) * 2 + 1
    return F.array(first, first.bitwiseXOR(step))


def repeated_cells(keys: DataFrame, bits: int) -> np.ndarray:
    """Words of the filter of cells hit by two rows or more.

    ``keys`` has the one column ``_key``. Cells are counted by partial
    aggregation and put together to words before they come to the driver:
    at most ``bits / 64`` rows.
    """
    twice = (
        keys.select(F.explode(cells(F.col("_key"), bits)).alias("_cell"))
        .groupBy("_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    one = F.expr("shiftleft(1L, cast(_cell & 63 as int))")
    words = twice.groupBy(F.shiftright("_cell", 6).alias("_word")).agg(
        F.bit_or(one).alias("_bits")
    )
    found = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["_word"].to_numpy(np.int64)] = found["_bits"].to_numpy(np.int64)
    return out


def possibly_repeated(words, bits: int):
    """A UDF on ``_key``: whether both cells are hit by two rows or more."""

    @F.pandas_udf("boolean")
    def asked(keys: pd.Series) -> pd.Series:
        key = keys.to_numpy(np.int64)
        first = key & (bits - 1)
        step = ((key.view(np.uint64) >> np.uint64(34)).astype(np.int64) & (bits // 2 - 1)) * 2 + 1
        hit = np.ones(len(key), bool)
        for cell in (first, first ^ step):
            hit &= (words.value[cell >> 6] >> (cell & 63)) & 1 == 1
        return pd.Series(hit)

    return asked


def _asked(df: DataFrame, text: str, key: str, max_bits: int) -> DataFrame:
    """Both passes: each packed row with its key, its text's hash and ``_maybe``."""
    rows = df.select(
        packed(df),
        F.col(key).alias("_id"),
        text_hash(F.col(text)).alias("_sha"),
    ).withColumn("_key", F.xxhash64("_sha"))
    bits = filter_bits(df.count(), max_bits)
    words = df.sparkSession.sparkContext.broadcast(repeated_cells(rows.select("_key"), bits))
    return rows.withColumn("_maybe", possibly_repeated(words, bits)("_key"))


def mark(
    df: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS
) -> DataFrame:
    """Each row with the group of its text.

    Adds ``keep_id`` (the smallest key of the group), ``group_size``, ``kept``
    and ``text_sha256``; input columns of these names are replaced. A null text
    counts as empty. Equal texts that also share the smallest key are told
    apart by the rest of their row, so one row of each group is kept. A null
    key is never the smallest unless all of the group are null. An empty table
    gives an empty result.
    """
    asked = _asked(df, text, key, max_bits)
    single = asked.where(~F.col("_maybe")).select(
        "_row",
        "_sha",
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    # both sides of the join below are tables, so each has an exchange of its own
    # and adaptive execution can split the partition of a hot group
    maybe = written(asked.where("_maybe").select("_row", "_sha", "_id"), "repeated")
    groups = written(
        maybe.groupBy("_sha").agg(
            F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    same = Window.partitionBy("_sha", "_id").orderBy(F.xxhash64("_row"))
    told = maybe.select(
        "_row", "_sha", "_id", F.row_number().over(same).alias("_n")
    ).join(groups, "_sha")
    grouped = told.select(
        "_row",
        "_sha",
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)).alias("kept"),
    )
    return single.unionByName(grouped).select(
        *unpacked(df.columns, ADDED),
        "keep_id",
        "group_size",
        "kept",
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(
    df: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of each group of equal texts, with the input's columns.

    The row that ``mark`` keeps. Groups are told from keys and hashes alone; texts
    do not shuffle while the rows to drop are few enough to be broadcast, and
    beyond that only those that the filter holds for possibly repeated.
    """
    asked = _asked(df, text, key, max_bits)
    single = asked.where(~F.col("_maybe"))
    maybe = asked.where("_maybe").withColumn("_hash", F.xxhash64("_row"))
    # rows equal in all columns are one row with a count; tables as in ``mark``
    rows = written(
        maybe.groupBy("_sha", "_id", "_hash").agg(F.count(F.lit(1)).alias("_n")), "repeated"
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_hash"))
    best = written(rows.groupBy("_sha").agg(first.alias("_best")), "groups")
    told = rows.join(best, "_sha").withColumn(
        "_stays", F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_hash") == F.col("_best._hash"))
    )
    # a table of its own, so that its real size decides how texts are joined
    gone = written(
        told.where("not _stays or _n > 1").select(
            F.col("_sha").alias("_s"), F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_stays"
        ),
        "gone",
    )

    def same(other: DataFrame) -> Column:
        return (
            (F.col("_sha") == other["_s"])
            & F.col("_id").eqNullSafe(other["_i"])
            & (F.col("_hash") == other["_h"])
        )

    kept = single.select("_row").unionByName(maybe.join(gone, same(gone), "left_anti").select("_row"))
    several = gone.where("_stays")
    if not several.isEmpty():
        # equal in all columns, so any of them is the one; combined before they shuffle
        again = maybe.join(several, same(several), "left_semi").groupBy("_sha").agg(F.first("_row").alias("_row"))
        kept = kept.unionByName(again.select("_row"))
    return kept.select(*unpacked(df.columns, []))
