"""Best-fit packing of token pieces by linear grouping.

Pieces longer than a quarter of a sequence are large. They are sorted by length
and cut into groups of equal cardinality; every piece is rounded up to the
longest of its group, so only a few sizes remain. The ways to fill a sequence
with those sizes are enumerated and a linear program, solved by column
generation, says how often to use each. Its whole part is taken, and the actual
pieces are put in place of the rounded ones. The room they really leave, and new
sequences, take the small pieces and the few large ones left over by best fit,
longest first.

Only histograms of lengths come to the driver (at most one row per length).
Rows find their places by their rank within their length, in parallel.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import written
from .common import partitions
from .subword import blocks, encoder

CAPACITY = 4096
GROUPS = 40
NEW = -1


def pieces(
    df: DataFrame,
    path: str,
    end_id: int,
    capacity: int = CAPACITY,
    text: str = "text",
    key: str = "doc_id",
    ids: bool = False,
) -> DataFrame:
    """Encoded texts cut into pieces of at most ``capacity`` tokens.

    Returns key, piece (from 0), start (ids of the text before it), length,
    ids_crc32 and, if asked for, the ids. A text ends with ``end_id``; a null
    text counts as empty and is that id alone. Only texts longer than a
    sequence are cut; other columns are not carried.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = [key, "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in blocks(texts):
                rows, at, parts = [], [], []
                for k, b in enumerate(enc.encode(texts[i:j])):
                    b += end
                    for p, s in enumerate(range(0, len(b), 4 * capacity)):
                        part = b[s : s + 4 * capacity]
                        at.append(i + k)
                        rows.append((p, s // 4, len(part) // 4, zlib.crc32(part)))
                        if ids:
                            parts.append(np.frombuffer(part, "<i4"))
                columns = [np.array(c, np.int64) for c in zip(*rows)]
                out = [
                    batch.column(1).take(pa.array(at, pa.int32())),
                    pa.array(columns[0].astype(np.int32)),
                    *[pa.array(c) for c in columns[1:]],
                ]
                if ids:
                    out.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.record_batch(out, names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    return df.select(text, key).mapInArrow(run, schema + (", ids array<int>" if ids else ""))


def ranked(df: DataFrame, by: str, order: list[str], name: str = "_rank") -> DataFrame:
    """Adds the rank (from 0) of each row among the rows of its ``by``.

    A value of ``by`` that holds many rows is dealt over as many salts as there
    are shuffle partitions; counts per salt give each its first rank.
    """
    salts = partitions(df.sparkSession)
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy(by, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(by, "_salt").orderBy(*order)
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(base, [by, "_salt"])
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_salt", "_base", "_in")
    )


def histogram(df: DataFrame, column: str) -> dict[int, int]:
    """Rows per value; ``column`` has at most ``capacity`` + 1 values."""
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All ways to put sizes larger than a quarter into one sequence."""
    if not sizes:
        return np.zeros((0, 0), np.int64)
    found = []
    for many in (1, 2, 3):
        for pick in combinations_with_replacement(range(len(sizes)), many):
            if sum(sizes[g] for g in pick) <= capacity:
                found.append(np.bincount(pick, minlength=len(sizes)))
    return np.array(found, np.int64).reshape(-1, len(sizes))


def optimise(counts: list[int], ways: np.ndarray) -> np.ndarray:
    """How often to use each way: the linear program's solution, rounded down.

    Minimises the sequences that hold ``counts`` pieces of each size, by column
    generation: a basis of as many ways as sizes, into which the way with the
    largest price enters until none is worth more than the one sequence it costs.
    """
    n = len(counts)
    need = np.array(counts, float) * (1 + 1e-9 * np.arange(1, n + 1))
    basis = []
    for g in range(n):
        alone = ways[:, g] == ways.sum(axis=1)
        basis.append(int(np.argmax(np.where(alone, ways[:, g], -1))))
    for _ in range(200 * n):
        square = ways[basis].T.astype(float)
        inverse = np.linalg.inv(square)
        price = inverse.sum(axis=0)
        worth = ways @ price
        enter = int(np.argmax(worth))
        if worth[enter] <= 1 + 1e-9:
            break
        level, change = inverse @ need, inverse @ ways[enter]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, level / change, np.inf)
        basis[int(np.argmin(ratio))] = enter
    level = np.linalg.inv(ways[basis].T.astype(float)) @ np.array(counts, float)
    use = np.zeros(len(ways), np.int64)
    for b, x in zip(basis, level):
        use[b] += max(0, int(np.floor(x + 1e-6)))
    return use


def group_plan(lengths: dict[int, int], capacity: int, groups: int) -> dict[str, np.ndarray | int]:
    """Places for large pieces, looked up by their rank from the longest on.

    ``first_rank`` gives each length the rank of its first piece; a group is
    ``width`` ranks. Runs of slots (group, slot from, slots, sequence from,
    slots a sequence) follow from how often each way is used.
    """
    ordered = sorted(lengths, reverse=True)
    total = sum(lengths.values())
    width = max(1, -(-total // groups))
    first = np.cumsum([0] + [lengths[x] for x in ordered])
    sizes, counts = [], []
    for start in range(0, total, width):
        sizes.append(ordered[int(np.searchsorted(first, start, "right")) - 1])
        counts.append(min(width, total - start))
    ways = configurations(sizes, capacity)
    use = optimise(counts, ways) if total else np.zeros(0, np.int64)
    filled = np.zeros(len(sizes), np.int64)
    runs, sequences = [], 0
    for way, times in zip(ways, use):
        if not times:
            continue
        for g in np.flatnonzero(way):
            slots = int(way[g] * times)
            runs.append((g, filled[g], slots, sequences, way[g]))
            filled[g] += slots
        sequences += int(times)
    runs.sort()
    return {
        "lengths": np.array(ordered[::-1], np.int64),
        "first_rank": first[:-1][::-1].astype(np.int64),
        "width": width,
        "runs": np.array(runs, np.int64).reshape(-1, 5),
        "sequences": sequences,
    }


def best_fit(items: dict[int, int], room: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, longest first, on histograms.

    ``room`` counts sequences by the room they have. Sequences of equal room
    and history are handled together. Returns runs (length, rank from, rank to,
    the sequences' room at the start or ``NEW``, first of them, pieces in each)
    and the number of new sequences.
    """
    free = {r: [(r, 0, n)] for r, n in room.items() if r > 0 and n > 0}
    order = sorted(free)
    runs, new = [], 0

    def give(left: int, run: tuple[int, int, int]) -> None:
        if left > 0:
            if left not in free:
                free[left] = []
                bisect.insort(order, left)
            free[left].append(run)

    for length in sorted(items, reverse=True):
        todo, rank = items[length], 0
        while todo:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                space = order[at]
                kind, start, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    order.pop(at)
            else:
                space, kind, start = capacity, NEW, new
                n = -(-todo // (capacity // length))
                new += n
            each = space // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, rank + full * each, kind, start, each))
                rank, todo = rank + full * each, todo - full * each
                give(space - each * length, (kind, start, full))
            used = full
            if todo and full < n:  # fewer than one sequence takes
                runs.append((length, rank, rank + todo, kind, start + full, todo))
                give(space - todo * length, (kind, start + full, 1))
                rank, todo, used = rank + todo, 0, full + 1
            if used < n:
                give(space, (kind, start + used, n - used))
    return np.array(runs, np.int64).reshape(-1, 6), new


def _large_place(plan: dict):
    runs = plan["runs"]
    keys = (runs[:, 0] << 40) + runs[:, 1]

    @F.pandas_udf("long")
    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(rank), -1, np.int64)
        if not len(keys):
            return pd.Series(out)
        # rows that are not large are asked too; their answer is not used
        at = np.searchsorted(plan["lengths"], length.to_numpy(np.int64))
        at = np.minimum(at, len(plan["lengths"]) - 1)
        overall = plan["first_rank"][at] + rank.to_numpy(np.int64)
        group, slot = overall // plan["width"], overall % plan["width"]
        run = np.searchsorted(keys, (group << 40) + slot, "right") - 1
        r = runs[np.maximum(run, 0)]
        ok = (run >= 0) & (r[:, 0] == group) & (slot - r[:, 1] < r[:, 2])
        out[ok] = (r[:, 3] + (slot - r[:, 1]) // r[:, 4])[ok]
        return pd.Series(out)

    return place


def _rest_place(runs: np.ndarray):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = (runs[:, 0] << 44) + runs[:, 1]

    @F.pandas_udf("struct<kind:long,nth:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        r = runs[np.searchsorted(keys, key, "right") - 1]
        nth = r[:, 4] + (rank.to_numpy(np.int64) - r[:, 1]) // r[:, 5]
        return pd.DataFrame({"kind": r[:, 3], "nth": nth})

    return place


def pack(
    rows: DataFrame,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    order: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """Every piece with sequence_id and offset.

    ``rows`` has a column length (1 to ``capacity``) and the columns of
    ``order``; all its columns are carried. Repeated rows are pieces of their
    own. Sequences hold at most ``capacity`` tokens without gaps. An empty
    table gives an empty result. Intermediate tables go to the shared folder.
    """
    columns = rows.columns
    by = list(order)
    all_rows = written(rows, "pieces")
    ranks = written(ranked(all_rows, "length", by), "ranked")
    lengths = histogram(all_rows, "length")
    large = {n: c for n, c in lengths.items() if capacity // 4 < n < capacity}
    plan = group_plan(large, capacity, groups)
    is_large = (F.col("length") > capacity // 4) & (F.col("length") < capacity)
    placed = written(
        ranks.withColumn(
            "sequence_id",
            F.when(is_large, _large_place(plan)("length", "_rank")).otherwise(F.lit(-1)),
        ),
        "placed",
    )
    base = plan["sequences"]
    full = placed.where(F.col("length") == capacity).withColumn("sequence_id", base + F.col("_rank"))
    base += lengths.get(capacity, 0)
    settled = placed.where("sequence_id >= 0")
    # the room left by the actual pieces, which are shorter than the rounded ones
    room = written(
        ranked(
            settled.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("_room")),
            "_room",
            ["sequence_id"],
            "_nth",
        ),
        "room",
    )
    rest = placed.where((F.col("sequence_id") < 0) & (F.col("length") < capacity)).drop("_rank", "sequence_id")
    runs, _ = best_fit(histogram(rest, "length"), histogram(room, "_room"), capacity)
    if len(runs):
        spots = ranked(rest, "length", by).withColumn("_spot", _rest_place(runs)("length", "_rank"))
        spots = written(
            spots.select(*columns, F.col("_spot.kind").alias("_room"), F.col("_spot.nth").alias("_nth")), "spots"
        )
        opened = spots.where(F.col("_room") == NEW).select(*columns, (base + F.col("_nth")).alias("sequence_id"))
        joined = spots.where(F.col("_room") != NEW).join(room, ["_room", "_nth"]).select(*columns, "sequence_id")
        fitted = opened.unionByName(joined)
    else:
        fitted = rest.withColumn("sequence_id", F.lit(0).cast("long"))
    found = (
        settled.select(*columns, "sequence_id")
        .unionByName(full.select(*columns, "sequence_id"))
        .unionByName(fitted.select(*columns, "sequence_id"))
    )
    # a sequence has at most as many pieces as tokens
    before = Window.partitionBy("sequence_id").orderBy(*by, "length").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
