"""Near duplicates by ProbMinHash, banding and verification.

Texts are weighted sets of five-word shingles. A shingle of weight w sends
arrivals of a Poisson process of rate w, drawn from its own hash, to random
components of the signature; the first arrival of a component sets it. Two
signatures agree in a component with the probability Jaccard similarity of their
sets. Arrivals are made in rounds and a shingle stops once its next arrival is
later than the last component's, so long texts cost little more than their size.

A text that repeats a shingle has a second signature over its distinct shingles,
all of weight one, whose agreement estimates plain Jaccard similarity; for other
texts both are the same. Both are cut into the same bands, so that copies which
repeat a line unequally often meet as well, and a pair passes if either agrees.

Texts of the same weighted set form a class with one representative. Bands of
the signatures bring representatives together in buckets. Each bucket compares
its members with its smallest one, by signature first and then exactly, and links
join components. That settles buckets of near copies alone. In the buckets that
still have several components, members outside the largest one visit all members,
block by block, inside tasks which return links only, so no link of a bucket is
lost and the pairs of a group are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import written
from .common import packed, unpacked

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
# A pair goes to exact comparison if its signatures of either kind agree in this
# share: four standard errors of 120 components below the least similarity.
ESTIMATE = 0.65
# Members of a bucket in one block of the comparison across components.
BLOCK = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORDS = 250_000


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: well spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(words: list[str], hashes: dict[str, int], size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; shorter texts are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = mixed(out * GOLDEN + h[i : len(h) - size + 1 + i])
    return mixed(out)


def weights(counts: np.ndarray) -> np.ndarray:
    """A repeated shingle weighs more, but less than its count."""
    return 1.0 + np.log(counts)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Signatures of (elements, weights) sets, one row each, of ``size`` components.

    All sets are advanced together, one arrival of every live element a round.
    Sets without an element keep zeros.
    """
    n = len(sets)
    first = np.full(n * size, np.inf)
    sign = np.zeros(n * size, np.uint64)
    lengths = np.array([len(e) for e, _ in sets], np.int64)
    owner = np.repeat(np.arange(n), lengths)
    element = np.concatenate([e for e, _ in sets]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if n else np.zeros(0)
    time = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        r = mixed(element + np.uint64(step * int(GOLDEN) % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        slot = owner * size + (mixed(r) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        sign[slot[won]] = element[won]
        last = first.reshape(n, size).max(axis=1)
        live = time < last[owner]
        owner, element, weight, time = owner[live], element[live], weight[live], time[live]
    return sign.reshape(n, size)


def banded(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash of each band; the band's number is part of it."""
    parts = signs.reshape(len(signs), bands, rows)
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        out = mixed(out * GOLDEN + parts[:, :, r])
    return out


def prints(df: DataFrame, text: str, key: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: key, class (hash of the weighted set, null without a word),
    signature (32 bits a component), buckets and the sorted multiset of shingles
    (32 bits each).

    A text that repeats a shingle has the signature of its distinct shingles
    behind the weighted one, and that one's buckets behind the others, null where
    both have the same. A bucket's place modulo ``bands`` is its band."""
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            if len(hashes) > WORDS:
                hashes.clear()
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                own = [np.sort(shingles((t or "").lower().split(), hashes)) for t in part]
                sets, plain = [], {}
                for k, s in enumerate(own):
                    e, c = np.unique(s, return_counts=True)
                    sets.append((e, weights(c)))
                    if len(e) < len(s):
                        plain[k] = (e, np.ones(len(e)))
                signs = prob_minhash([*sets, *plain.values()], size)
                small = (signs >> np.uint64(32)).astype("<u4")
                keys = banded(small.astype(np.uint64), bands, rows).view(np.int64)
                signed, placed = [x.tobytes() for x in small[: len(own)]], list(keys[: len(own)])
                for j, k in enumerate(plain, len(own)):
                    signed[k] += small[j].tobytes()
                    placed[k] = keys[k].tolist() + [
                        q if q != p else None for p, q in zip(keys[k].tolist(), keys[j].tolist())
                    ]
                some = [len(s) > 0 for s in own]
                yield pa.record_batch(
                    [
                        batch.column(1).slice(at, len(part)),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if k else None for s, k in zip(own, some)], pa.binary()),
                        pa.array(signed, pa.binary()),
                        pa.array([x if k else [] for x, k in zip(placed, some)], pa.list_(pa.int64())),
                        pa.array([np.sort((s >> np.uint64(32)).astype("<u4")).tobytes() for s in own], pa.binary()),
                    ],
                    ["id", "class", "sign", "buckets", "bag"],
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, class binary, sign binary, buckets array<long>, bag binary"
    return df.select(text, key).mapInArrow(run, schema)


def similarity(a: bytes, b: bytes) -> float:
    """The larger of probability Jaccard and plain Jaccard of two multisets.

    The first is what the weighted signatures estimate, the second what those of
    distinct shingles do: it ignores repeats, so texts that differ in how often
    they repeat a line are near copies as well.
    """
    x, nx = np.unique(np.frombuffer(a, "<u4"), return_counts=True)
    y, ny = np.unique(np.frombuffer(b, "<u4"), return_counts=True)
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(x) + len(y) - len(common))
    wx, wy = weights(nx), weights(ny)
    if nx.max() == 1 and ny.max() == 1:
        return plain
    # for a common element, the sum over all of max(wx/wx_i, wy/wy_i): elements
    # of one set alone give their weight over w_i, common ones by sorted ratios
    cx, cy = wx[i], wy[j]
    only_x, only_y = wx.sum() - cx.sum(), wy.sum() - cy.sum()
    order = np.argsort(cx / cy)
    sx = np.append(0.0, np.cumsum(cx[order]))
    sy = np.append(0.0, np.cumsum(cy[order]))
    ratio = (cx / cy)[order]
    cut = np.searchsorted(ratio, ratio, "right")
    total = (only_x + sx[-1] - sx[cut]) / cx[order] + (only_y + sy[cut]) / cy[order]
    return max(plain, float((1 / total).sum()))


def _both(sign: bytes) -> np.ndarray:
    """The weighted signature and that of distinct shingles, one row each."""
    x = np.frombuffer(sign, "<u4")
    return np.stack([x[: BANDS * ROWS], x[-BANDS * ROWS :]])


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """The larger share of agreement of both kinds of signatures."""
    x, y = a.to_pylist(), b.to_pylist()
    found = [(_both(p) == _both(q)).mean(axis=1).max() for p, q in zip(x, y)]
    return pa.array(found, pa.float64())


def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(p, q) for p, q in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) after joining those that ``links`` (a, b) touch.

    Works on links between components: each hooks its larger end to the smaller,
    pointers are halved until flat, and the links that remain are contracted,
    until none is left. Every step halves the components that still have links.
    """
    a = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))

    def between(pairs: DataFrame) -> DataFrame:
        return pairs.where("ca <> cb").select(
            F.greatest("ca", "cb").alias("x"), F.least("ca", "cb").alias("y")
        ).distinct()

    edges = written(between(links.join(a, "a").join(b, "b")), "edges")
    while not edges.isEmpty():
        hooks = written(edges.groupBy("x").agg(F.min("y").alias("p")), "hooks")
        while True:  # p of p, until each points to a root
            up = hooks.select(F.col("x").alias("p"), F.col("p").alias("q"))
            jumped = written(
                hooks.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("m")),
                "jumped",
            )
            moved = not jumped.where("m").isEmpty()
            hooks = jumped.select("x", "p")
            if not moved:
                break
        root = hooks.select(F.col("x").alias("comp"), F.col("p").alias("root"))
        comps = written(
            comps.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "comps"
        )
        left = hooks.select("x", F.col("p").alias("cx"))
        right = hooks.select(F.col("x").alias("y"), F.col("p").alias("cy"))
        edges = written(
            between(
                edges.join(left, "x", "left").join(right, "y", "left").select(
                    F.coalesce("cx", "x").alias("ca"), F.coalesce("cy", "y").alias("cb")
                )
            ),
            "edges",
        )
    return comps


def components(worded: DataFrame, firsts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(id, comp) for representatives that share a bucket with another.

    ``worded`` has id, class, sign, buckets and bag of all texts, ``firsts`` the
    representative of each class. Only narrow columns are joined before it is
    known which representatives share a bucket; few of them carry shingles on.
    """
    own = firsts.select(F.col("rep").alias("id"), "class")
    each = (
        worded.select("id", "class", "buckets")
        .join(own, ["id", "class"], "left_semi")
        .select("id", F.posexplode("buckets").alias("place", "bucket"))
        .where("bucket is not null")
        .select("id", (F.col("place") % BANDS).alias("band"), "bucket")
    )
    # written, so that the join has two exchanges and a hot bucket can be split
    shared = written(
        each.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre"))
        .where("n > 1"),
        "shared",
    )
    members = written(each.join(shared, "bucket"), "buckets")
    ids = written(members.select("id").distinct(), "ids")
    comps = ids.withColumn("comp", F.col("id"))
    sets = written(
        worded.select("id", "class", "sign", "bag")
        .join(ids, "id", "left_semi")
        .join(own, ["id", "class"], "left_semi")
        .select("id", "sign", "bag"),
        "sets",
    )
    pairs = (
        members.where("id <> centre")
        .select(F.col("centre").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    comps = merged(comps, written(_linked(written(pairs, "pairs"), sets, threshold), "links"))
    return merged(comps, written(_crossed(members, comps, sets, threshold), "links"))


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar: by signature, then exactly."""
    sign = sets.select(F.col("id").alias("a"), F.col("sign").alias("sa"))
    other = sets.select(F.col("id").alias("b"), F.col("sign").alias("sb"))
    near = written(
        pairs.join(other, "b")
        .join(sign, "a")
        .where(F.arrow_udf(_alike, "double")("sa", "sb") >= ESTIMATE)
        .select("a", "b"),
        "near",
    )
    # members first: each pair then carries its member's shingles to the centre,
    # whose own are not repeated before the last join
    bag = sets.select(F.col("id").alias("a"), F.col("bag").alias("ba"))
    other = sets.select(F.col("id").alias("b"), F.col("bag").alias("bb"))
    return (
        near.join(other, "b")
        .join(bag, "a")
        .where(F.arrow_udf(_similar, "double")("ba", "bb") >= threshold)
        .select("a", "b")
    )


def _crossed(members: DataFrame, comps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket and different components.

    A bucket of one component needs no comparison. In the others every such pair
    has a member outside the bucket's largest component. Those outside are guests:
    in groups of about ``BLOCK`` they visit all blocks of about ``BLOCK`` members,
    so a member is repeated once per group of guests, not once per block. Each
    visit is one unit, which compares signatures, then shingles, and returns
    links alone. A pair is compared exactly in the first band of which it shares
    a bucket.
    """
    told = written(members.select("id", "band", "bucket").join(comps, "id"), "told")
    open_ = written(
        told.groupBy("bucket", "comp")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("comps"),
            F.sum("n").alias("n"),
            F.max(F.struct("n", "comp")).alias("top"),
        )
        .where("comps > 1")
        .select(
            "bucket",
            F.col("top.comp").alias("top"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("groups"),
        ),
        "open",
    )
    order, few = F.xxhash64("id"), F.col("comp") != F.col("top")

    def unit_of(block: Column, group: Column, guest: bool) -> Column:
        return F.struct(block.alias("block"), group.alias("group"), F.lit(guest).alias("guest"))

    block, group = [F.pmod(order, F.col(n)).cast("int") for n in ("blocks", "groups")]
    numbers = [F.sequence(F.lit(0), F.col(n) - 1) for n in ("blocks", "groups")]
    at_home = F.transform(numbers[1], lambda g: unit_of(block, g, False))
    visiting = F.transform(numbers[0], lambda b: unit_of(b, group, True))
    rows = (
        told.join(open_, "bucket")
        .withColumn("_unit", F.explode(F.when(few, F.concat(at_home, visiting)).otherwise(at_home)))
        .select("id", "band", "bucket", "comp", few.alias("few"), order.alias("order"), "_unit.*")
    )
    kind = sets.schema["id"].dataType.simpleString()

    def unit(group: pa.Table) -> pa.Table:
        a, b = _unit_links(group, threshold)
        own = group.column("id").combine_chunks()
        return pa.table([own.take(pa.array(a, pa.int64())), own.take(pa.array(b, pa.int64()))], ["a", "b"])

    return (
        rows.join(sets, "id")
        .groupBy("bucket", "block", "group")
        .applyInArrow(unit, f"a {kind}, b {kind}")
        .distinct()
    )


def _unit_links(group: pa.Table, threshold: float) -> tuple[list[int], list[int]]:
    """Positions of the linked pairs of a unit: guests with members of other
    components. Two that are both guests meet twice, in either's block; the one
    that comes first by ``order`` compares."""
    n = group.num_rows
    comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
    # weighted signatures and those of distinct shingles: n, kind, band, row
    sign = np.stack([_both(s) for s in group.column("sign").to_pylist()]).reshape(n, 2, BANDS, -1)
    bags = group.column("bag").to_pylist()
    band = group.column("band")[0].as_py()
    order = group.column("order").to_numpy()
    guest, few = [np.array(group.column(c).to_pylist(), bool) for c in ("guest", "few")]
    home = np.flatnonzero(~guest)
    a, b = [], []
    for i in np.flatnonzero(guest).tolist():
        with_ = home[(comp[home] != comp[i]) & (~few[home] | (order[i] <= order[home]))]
        same = sign[with_] == sign[i]
        near = with_[same.mean(axis=(2, 3)).max(axis=1) >= ESTIMATE]
        # buckets hold both kinds, so one's kind may meet the other's
        met = (sign[near][:, :, None] == sign[i][None, None]).all(axis=4).any(axis=(1, 2))
        for j in near[met.argmax(axis=1) == band].tolist():
            if similarity(bags[i], bags[j]) >= threshold:
                a.append(i)
                b.append(j)
    return a, b


def classes(
    df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = SIMILARITY
) -> DataFrame:
    """(key, class_id): the smallest key among a row's near duplicates.

    Near means a chain of pairs of similarity ``threshold`` or more. Words are
    runs of non-space characters, case ignored; a text of fewer than five words
    is one shingle. Null and empty texts have no shingle and stay alone. Rows
    with a null key are left out; rows that repeat a key are one document with
    all their texts. An empty table gives an empty result.
    """
    found = written(prints(df.where(F.col(key).isNotNull()), text, key), "prints")
    worded = found.where("class is not null")
    firsts = written(worded.groupBy("class").agg(F.min("id").alias("rep")), "classes")
    members = worded.select("id", "class").join(firsts, "class").select("id", "rep")
    comps = components(worded, firsts, threshold)
    named = members.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    alone = found.where("class is null").select("id", F.col("id").alias("class_id"))
    return (
        named.select("id", F.coalesce("comp", "rep").alias("class_id"))
        .unionByName(alone)
        .groupBy("id")
        .agg(F.min("class_id").alias("class_id"))
        .withColumnRenamed("id", key)
    )


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class: the smallest key's, with the input's columns.

    Rows with a null key and rows without a word are kept. Rows that repeat a
    key are one document: the first by the hash of its columns is kept.
    """
    found = written(classes(df, text, key), "found")
    # a table of its own, so that its real size decides how texts are joined
    gone = written(
        found.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_id")), "gone"
    )
    rows = df.select(packed(df), F.col(key).alias("_id"))
    kept = rows.join(gone, "_id", "left_anti")
    again = written(
        df.groupBy(F.col(key).alias("_id")).count().where("count > 1 and _id is not null").select("_id"), "again"
    )
    if not again.isEmpty():
        order = Window.partitionBy("_id").orderBy(F.xxhash64("_row"))
        repeated = kept.join(again, "_id", "left_semi").withColumn("_n", F.row_number().over(order))
        kept = kept.join(again, "_id", "left_anti").unionByName(repeated.where("_n = 1").drop("_n"))
    return kept.select(*unpacked(df.columns, []))
