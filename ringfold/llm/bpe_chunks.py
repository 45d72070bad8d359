"""BPE encoding with content-defined chunks that documents share.

A rolling hash over 16 characters cuts every text where the hash says so, hence
equal passages are cut alike wherever they stand. The most repeated chunks of
the corpus (up to ``BOOK`` of them) are encoded once, in one job, and given to
all tasks; other chunks are encoded once per Python worker while it remembers
them. Encodings of neighbouring chunks cannot simply be joined: a word may span
the cut. The end of the left chunk and the start of the right one are therefore
encoded again as one window. The window is widened until both its edges lie
before white space that follows a word: no token of these tokenizers spans such a
place, so window and chunks agree there exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .subword import Encoder, blocks, encoder

# Chunks of the shared book: about 1,000 characters each, so some 20 MB of text.
BOOK = 16_384
# A longer chunk (a run without any cut) is not worth sharing.
LONGEST = 8_192
# Characters of chunk texts that one worker remembers.
REMEMBERED = 24_000_000
CUT_BITS = 10
EDGE = re.compile(r"(?<=[^\t-\r ])[\t-\r ]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def chunks(text: str) -> list[str]:
    """The text in content-defined chunks; an empty text has none."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(a):
        return []
    power, width = FACTOR, 1
    while width < 16:  # the hash of 2 * width characters from two of width
        a[width:] += a[:-width].copy() * power if len(a) > width else np.uint64(0)
        power, width = np.uint64(int(power) ** 2 % 2**64), width * 2
    a *= FACTOR
    cuts = np.flatnonzero((a >> np.uint64(64 - CUT_BITS)) == 0) + 1
    ends = cuts.tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def record(chunk: str) -> tuple[int, int] | None:
    """Where a chunk's own encoding starts and ends; None without two edges."""
    first = EDGE.search(chunk)
    if first is None:
        return None
    last = first.start()
    for i in range(len(chunk) - 1, last, -1):
        if chunk[i] in "\t\n\v\f\r " and chunk[i - 1] not in "\t\n\v\f\r ":
            last = i
            break
    return first.start(), last


class Reuse:
    """Encodes texts chunk by chunk, reusing what it has seen."""

    def __init__(self, enc: Encoder, book: dict[str, bytes]) -> None:
        self.enc, self.book = enc, book
        self.seen: dict[str, tuple[int, int, bytes] | None] = {}
        self.size = 0

    def learn(self, new: list[str]) -> None:
        if self.size > REMEMBERED:
            self.seen.clear()
            self.size = 0
        at = {c: record(c) for c in new}
        todo = [c for c in new if at[c] is not None and c not in self.book]
        ids = dict(zip(todo, self.enc.encode([c[at[c][0] : at[c][1]] for c in todo])))
        for c in new:
            if at[c] is None:
                self.seen[c] = None
            else:
                own = self.book.get(c)
                self.seen[c] = (*at[c], ids[c] if own is None else own)
            self.size += len(c)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [chunks(t) for t in texts]
        if self.size > REMEMBERED:
            self.learn([])
        self.learn(list({c for cs in cut for c in cs if c not in self.seen}))
        plan: list[list[bytes | int]] = []
        windows: list[str] = []
        for cs in cut:
            parts: list[bytes | int] = []
            carry: list[str] = []
            for c in cs:
                known = self.seen[c]
                if known is None:
                    carry.append(c)
                    continue
                start, end, ids = known
                carry.append(c[:start])
                parts += [len(windows), ids]
                windows.append("".join(carry))
                carry = [c[end:]]
            parts.append(len(windows))
            windows.append("".join(carry))
            plan.append(parts)
        seams = self.enc.encode(windows)
        return [
            b"".join([seams[p] if isinstance(p, int) else p for p in parts])
            for parts in plan
        ]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "surrogatepass"))


def shared_book(df: DataFrame, text: str, path: str, size: int = BOOK) -> dict[str, bytes]:
    """The most repeated chunks of the corpus with their encodings.

    Counts cover all chunks; only the ``size`` most repeated come to the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hash(c) for t in _texts(batch.column(0)) for c in chunks(t) if len(c) <= LONGEST]
            keys, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], ["k", "n"])

    top = (
        df.select(text)
        .mapInArrow(counted, "k long, n long")
        .groupBy("k")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "k")
        .limit(size)
        .toPandas()
    )
    wanted = frozenset(top["k"].tolist())
    if not wanted:
        return {}

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            keys, texts = [], []
            for t in _texts(batch.column(0)):
                for c in chunks(t):
                    if len(c) <= LONGEST:
                        key = int(np.uint64(_hash(c)).view(np.int64))
                        if key in wanted and key not in given:
                            given.add(key)
                            keys.append(key)
                            texts.append(c)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], ["k", "c"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = [record(c) for c in texts]
            mids = ["" if a is None else c[a[0] : a[1]] for c, a in zip(texts, at)]
            yield pa.record_batch([batch.column(1), pa.array(enc.encode(mids), pa.binary())], ["c", "ids"])

    rows = (
        df.select(text)
        .mapInArrow(picked, "k long, c string")
        .groupBy("k")
        .agg(F.min("c").alias("c"))
        .mapInArrow(encoded, "c string, ids binary")
        .toPandas()
    )
    return dict(zip(rows["c"], rows["ids"]))


def encode_decode(
    df: DataFrame, path: str, text: str = "text", key: str = "doc_id", book: int = BOOK
) -> DataFrame:
    """Every row's key with its ids and the text they decode to.

    Returns key, ids (array<int>) and decoded. A null text counts as empty and
    has no ids. Repeated rows each give a row; other columns are not carried.
    An empty table gives an empty result.
    """
    return _mapped(df, path, text, key, book, digest=False)


def digest(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", book: int = BOOK) -> DataFrame:
    """As ``encode_decode``, with digests in place of ids and decoded text."""
    return _mapped(df, path, text, key, book, digest=True)


def _mapped(df: DataFrame, path: str, text: str, key: str, book: int, digest: bool) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(shared_book(df, text, path, book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        reuse = Reuse(enc, shared.value)
        for batch in batches:
            texts = _texts(batch.column(1))
            for i, j in blocks(texts):
                ids = reuse.encode(texts[i:j])
                plain = enc.decode(ids)
                n = [len(b) // 4 for b in ids]
                own = batch.column(0).slice(i, j - i)
                if digest:
                    yield pa.record_batch(
                        [
                            own,
                            pa.array(n, pa.int64()),
                            pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                            pa.array([hashlib.sha256(p.encode()).hexdigest() for p in plain]),
                        ],
                        [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    yield pa.record_batch(
                        [own, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(plain)],
                        [key, "ids", "decoded"],
                    )

    kind = df.schema[key].dataType.simpleString()
    added = (
        "n_tokens long, ids_sha256 string, decoded_sha256 string"
        if digest
        else "ids array<int>, decoded string"
    )
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {added}")
