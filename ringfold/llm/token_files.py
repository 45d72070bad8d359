"""Token ids as Parquet list columns that can be read in part.

One row per document in ascending key order: the key, n_tokens, the ids and any
chosen metadata columns. Ids are dictionary encoded (a vocabulary has few
values for so many tokens), keys and counts delta encoded. Row groups and pages
are small, and Parquet's page index lets a reader with a key range or with some
of the columns skip the rest. Files follow each other in key order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .subword import blocks, encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
# Words that an encoder remembers here: case and the leading space are part of
# them, so there are more than the default holds.
WORDS = 600_000


def tokens(
    df: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id", meta: tuple[str, ...] = ()
) -> DataFrame:
    """key, metadata, n_tokens and ids of every row, in the order of the rows."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, WORDS)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in blocks(texts):
                ids = [b + end for b in enc.encode(texts[i:j])]
                n = np.array([len(b) // 4 for b in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                own = [batch.column(c).slice(i, j - i) for c in range(1, batch.num_columns)]
                yield pa.record_batch(
                    [*own, pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    [key, *meta, "n_tokens", "ids"],
                )

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *meta))
    return df.select(text, key, *meta).mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>")


def write(
    df: DataFrame,
    out: str,
    path: str,
    end_id: int,
    text: str = "text",
    key: str = "doc_id",
    meta: tuple[str, ...] = (),
) -> None:
    """Encode every row and write the files to ``out``.

    A null text counts as empty: its row has the end id alone. Null keys come
    first; rows of one key stay separate rows. Columns other than ``meta`` are
    not written. Rows are spread by key ranges before they are encoded, so only
    texts shuffle, once. An empty table gives files without rows.
    """
    ordered = df.select(text, key, *meta).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = (
        tokens(ordered, path, end_id, text, key, meta)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
    )
    for column in (key, "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(out)


def read(spark: SparkSession, out: str, columns: list[str]) -> DataFrame:
    """Some columns of every row, with its file's number and its row there."""
    number = F.regexp_extract("_metadata.file_name", "part-(\\d+)", 1).cast("int")
    return spark.read.parquet(out).select(
        *columns, number.alias("_file"), F.col("_metadata.row_index").alias("_at")
    )


def starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds start: the ids in all rows before. ``counts`` has the stored n_tokens
    of all rows; files are summed first, so no window is larger than a file or
    the list of files."""
    files = counts.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(base, "_file")
        .withColumn("start", F.col("_base") + F.col("_in"))
        .drop("_base", "_in")
    )


def digest(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Per row of the files: key, start, n_tokens and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])]
            rest = [batch.column(c) for c in range(1, batch.num_columns)]
            yield pa.record_batch(
                [*rest, pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                [key, "_file", "_at", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, out, [key, "ids"]).select("ids", key, "_file", "_at")
    kind = rows.schema[key].dataType.simpleString()
    found = rows.mapInArrow(run, f"`{key}` {kind}, _file int, _at long, n_tokens long, ids_crc32 long")
    return starts(found, read(spark, out, ["n_tokens"])).select(key, "start", "n_tokens", "ids_crc32")
