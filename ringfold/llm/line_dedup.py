"""Line deduplication that can be taken back, document by document.

A ``LineIndex`` is a folder of versions in shared storage. Each version holds

* ``counts``: for each key of a line (SHA-256 of its stripped, lower-cased text)
  the exact number of documents with it, and
* ``filters``: per shard of the key hashes a cuckoo filter of the keys that
  ``min_docs`` documents or more have, with the hashes it had no cell for.

``insert`` and ``delete`` add or subtract the counts of some documents and put
the keys that thereby pass the threshold into their shard's filter or take them
out; a filter that gets too full is built anew from the counts. Each gives a new
version and leaves the old one as it is, so a lost job spoils nothing, and
deleting what was inserted brings the earlier decisions back.

``dedup`` asks the filters where the documents are read. Documents without a
line that a filter may hold pass straight through; of the others narrow rows
(hash of the text, line number, key) shuffle to be looked up in the counts, so
results are exact. Filters are broadcast up to ``max_bytes``; shards beyond
that answer "maybe", so more rows are looked up and no decision changes.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lineage import scratch_path, written
from .common import named, packed, unpacked
from .cuckoo import CuckooFilter, asked, buckets_for, fits

SPACE = b" \t\n\v\f\r"
ADDED = ["n_lines", "n_dropped", "kept_text"]
MAX_BYTES = 64 << 20
# Distinct keys counted together in a task before their counts are handed on.
TOGETHER = 200_000
COUNTS = "key binary, was long, n_docs long"
FILTERS = "shard int, buckets int, items long, cells binary, extra array<bigint>"
FOUND = "struct<n:int,maybe:array<struct<at:int,key:binary>>>"


def line_keys(text: bytes, min_chars: int = 1) -> list[bytes | None]:
    """Per line the SHA-256 of its key (ASCII white space stripped, A-Z
    lower-cased), or None where the key has fewer code points."""
    keys = [x.strip(SPACE) for x in text.lower().split(b"\n")]
    if min_chars > 1:
        keys = [k if len(k.decode()) >= min_chars else b"" for k in keys]
    return [sha256(k).digest() if k else None for k in keys]


def hashes(keys: list[bytes]) -> np.ndarray:
    """The 64 bits of a key that a filter works with."""
    return np.frombuffer(b"".join(keys), "<i8")[::4].copy()


class LineIndex:
    """Line counts and filters in a folder; methods return a new version."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        version: str | None = None,
        min_docs: int = 10,
        min_chars: int = 1,
        shards: int = 64,
    ) -> None:
        """``shards`` is a power of two. Without a version the index is empty."""
        if shards < 1 or shards & (shards - 1):
            raise ValueError("shards must be a power of two")
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.min_docs, self.min_chars, self.shards = min_docs, min_chars, shards

    @classmethod
    def scratch(cls, spark: SparkSession, **settings) -> "LineIndex":
        """An empty index among this application's step tables."""
        return cls(spark, scratch_path(spark, "line-index"), **settings)

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.version}/{name}")

    def _changes(self) -> DataFrame:
        """Every line of this version or the one before, with both counts."""
        return self._read("counts", COUNTS)

    def counts(self) -> DataFrame:
        """key (binary) and n_docs of every line known."""
        return self._changes().where("n_docs > 0").drop("was")

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    def insert(self, docs: DataFrame, text: str = "text") -> "LineIndex":
        """The index with these documents too; a row is a document."""
        return self._changed(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> "LineIndex":
        """The index without these documents. They must have been inserted: a
        count below zero fails the job and leaves the index as it is."""
        return self._changed(docs, text, -1)

    def _changed(self, docs: DataFrame, text: str, sign: int) -> "LineIndex":
        min_chars = self.min_chars

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()

            def part() -> pa.RecordBatch:
                return pa.record_batch(
                    [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "n"]
                )

            for batch in batches:
                for t in batch.column(0).cast(pa.binary()).to_pylist():
                    keys = set(line_keys(t or b"", min_chars))
                    keys.discard(None)
                    seen.update(keys)
                    if len(seen) >= TOGETHER:
                        yield part()
                        seen.clear()
            yield part()

        new = (
            docs.select(named(text))
            .mapInArrow(count, "key binary, n long")
            .groupBy("key")
            .agg(F.sum("n").alias("n"))
            .select("key", F.lit(0).cast("long").alias("was"), (sign * F.col("n")).alias("n"))
        )
        if self.version is not None:
            old = self.counts().select("key", F.col("n_docs").alias("was"), F.col("n_docs").alias("n"))
            new = old.unionAll(new).groupBy("key").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))
        name = f"version-{uuid.uuid4().hex}"
        after = LineIndex(self.spark, self.folder, name, self.min_docs, self.min_chars, self.shards)
        place = f"{self.folder}/{name}"
        wrong = F.raise_error(F.lit("a document to delete is not in the index")).cast("long")
        new.select(
            "key",
            "was",
            F.when(F.col("n") < 0, wrong).otherwise(F.col("n")).alias("n_docs"),
        ).write.parquet(f"{place}/counts")
        self._filtered(after._changes()).write.parquet(f"{place}/filters")
        return after

    def _shard(self) -> Column:
        last = F.conv(F.hex(F.substring("key", 7, 2)), 16, 10).cast("int")
        return last.bitwiseAND(F.lit(self.shards - 1))

    def _filtered(self, counted: DataFrame) -> DataFrame:
        """The filters after a change of counts (``was`` and ``n_docs``)."""
        rows = counted.select(
            self._shard().alias("shard"),
            "key",
            (F.col("was") >= self.min_docs).alias("old"),
            (F.col("n_docs") >= self.min_docs).alias("new"),
        ).where("old or new")
        # one row per shard: which filters have no room for what comes
        sizes = (
            rows.groupBy("shard")
            .agg(F.sum(F.col("new").cast("long")).alias("items"))
            .join(self.filters().select("shard", "buckets"), "shard", "full")
            .collect()
        )
        anew = [r["shard"] for r in sizes if r["buckets"] is None or not fits(r["items"] or 0, r["buckets"])]
        again = F.col("shard").isin(anew)
        changes = rows.where(F.when(again, F.col("new")).otherwise(F.col("old") != F.col("new")))
        kept = self.filters().where(~again)

        def update(shard: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            added = hashes(keys.loc[keys["new"], "key"].tolist()).tolist()
            gone = hashes(keys.loc[~keys["new"], "key"].tolist()).tolist()
            if len(old):
                row = old.iloc[0]
                known, cells = int(row["items"]), CuckooFilter(int(row["buckets"]), row["cells"], row["extra"])
            else:
                known, cells = 0, CuckooFilter(buckets_for(len(added)))
            for h in gone:
                cells.remove(h)
            for h in added:
                cells.add(h)
            items = known + len(added) - len(gone)
            return pd.DataFrame(
                [[shard[0], cells.buckets, items, cells.to_bytes(), cells.extra]],
                columns=["shard", "buckets", "items", "cells", "extra"],
            )

        return kept.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, FILTERS)

    def dedup(self, docs: DataFrame, text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
        """Every row with its text less the lines that too many documents have.

        Adds n_lines (before dropping), n_dropped and kept_text; input columns
        of these names are replaced. A null or empty text is one empty line,
        which stays. Repeated rows are documents of their own. An empty table
        gives an empty result. Texts are read twice; only rows with a line that
        may be dropped shuffle, once.
        """
        told = docs.select(
            packed(docs), named(text).alias("_text"), self._asked(max_bytes)(named(text)).alias("_found")
        )
        some = told.where(F.size("_found.maybe") > 0).select("*", F.sha2("_text", 256).alias("_id"))
        narrow = written(
            some.groupBy("_id")
            .agg(F.any_value("_found.maybe").alias("_lines"))
            .select("_id", F.explode("_lines").alias("_line"))
            .select("_id", "_line.at", "_line.key"),
            "maybe-lines",
        )
        many = written(self.counts().where(F.col("n_docs") >= self.min_docs).select("key"), "frequent-lines")
        # as a table, so that the join below has an exchange of its own on both
        # sides and adaptive execution can split the partition of a hot text
        dropped = written(
            narrow.join(many, "key").groupBy("_id").agg(F.collect_list("at").alias("_drop")), "dropped-lines"
        )
        none = F.lit(None).cast("array<int>").alias("_drop")
        whole = told.where(F.size("_found.maybe") == 0).select("_row", "_text", "_found.n", none)
        both = some.join(dropped, "_id", "left").select("_row", "_text", "_found.n", "_drop")
        return whole.unionByName(both).select(*unpacked(docs.columns, ADDED), *_without())

    def _asked(self, max_bytes: int):
        """A UDF: the number of lines, and number and key of each that a filter
        may hold."""
        sizes = self.filters().select("shard", F.length("cells") + 8 * F.size("extra")).orderBy("shard").collect()
        total, fit, unknown = 0, [], []
        for shard, size in sizes:
            (fit if total + size <= max_bytes else unknown).append(shard)
            total += size if total + size <= max_bytes else 0
        held = {
            r["shard"]: (np.frombuffer(r["cells"], "<u2"), r["buckets"], np.array(r["extra"], np.int64))
            for r in self.filters().where(F.col("shard").isin(fit)).collect()
        }
        filters = self.spark.sparkContext.broadcast(held)
        shards, min_chars = self.shards, self.min_chars

        def ask(texts: pa.Array) -> pa.Array:
            sizes, keys, at = [], [], []
            for t in texts.cast(pa.binary()).to_pylist():
                own = line_keys(t or b"", min_chars)
                sizes.append(len(own))
                keys += own
            known = np.array([k is not None for k in keys], bool)
            at = np.flatnonzero(known)
            flat = hashes([keys[i] for i in at])
            hit = np.zeros(len(flat), bool)
            shard = _shards(flat, shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            for s, (cells, buckets, extra) in filters.value.items():
                rows = order[cut[s] : cut[s + 1]]
                if len(rows):
                    hit[rows] = asked(cells, buckets, extra, flat[rows])
            for s in unknown:
                hit[order[cut[s] : cut[s + 1]]] = True
            at = at[hit]
            ends = np.cumsum([0, *sizes])
            line = at - ends[np.searchsorted(ends, at, "right") - 1]
            rows = pa.StructArray.from_arrays(
                [pa.array(line.astype(np.int32)), pa.array([keys[i] for i in at], pa.binary())], ["at", "key"]
            )
            cuts = np.searchsorted(at, ends).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), rows)
            return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), lists], ["n", "maybe"])

        # said to be nondeterministic, so that a condition on it is not moved
        # before it and the texts are searched once
        return F.arrow_udf(ask, FOUND).asNondeterministic()


def _shards(flat: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: its last two bytes, read as in the tables."""
    return flat.view(np.uint64).astype("<u8").view("<u2")[3::4].byteswap() & np.uint16(shards - 1)


def _without() -> list[Column]:
    """n_lines, n_dropped and kept_text from a text and its dropped line numbers."""
    gone, text = F.coalesce("_drop", F.array().cast("array<int>")), F.coalesce("_text", F.lit(""))
    stays = F.transform(
        F.array(F.split(text, "\n")),
        lambda ls: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)
            ),
            "\n",
        ),
    )[0]
    return [
        F.col("n").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.when(F.size(gone) == 0, text).otherwise(stays).alias("kept_text"),
    ]
