"""Exact and near duplicates against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ringfold.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, kept string, _sha string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def test_exact_groups_and_clashing_columns(spark):
    rows = [(5, "a  b"), (3, "a\n b"), (9, "a b "), (1, None), (2, ""), (3, "a\n b"), (None, "a b"), (7, "c")]
    out = exact_dedup.mark(docs(spark, rows)).collect()
    kept = sorted((r["doc_id"], r["text"]) for r in out if r["kept"])
    assert kept == [(1, None), (3, "a\n b"), (7, "c"), (9, "a b ")]
    assert {r["group_size"] for r in out if r["keep_id"] == 3} == {4}
    assert out[0]["_sha"] == "y" and len(out) == len(rows)
    assert exact_dedup.exact_dedup(docs(spark, rows)).columns == ["doc_id", "text", "kept", "_sha"]
    assert exact_dedup.mark(docs(spark, rows).limit(0)).count() == 0


def test_exact_dedup_keeps_what_is_marked(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(6)]), rng.choice(["a b", "a  b", "", None, f"t{i}", "x" * 300_000])) for i in range(80)]
    df = docs(spark, rows).withColumn("_sha", F.col("text").substr(1, 1))
    want = Counter((r["doc_id"], r["text"]) for r in exact_dedup.mark(df.drop("kept")).where("kept").collect())
    for bits in (64, 1 << 16):
        got = Counter((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(df, max_bits=bits).collect())
        assert got == want
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_full_filter_only_sends_more_rows(spark):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    for bits in (64, 1 << 16):
        out = exact_dedup.mark(docs(spark, rows), max_bits=bits).collect()
        assert sorted(r["doc_id"] for r in out if r["kept"]) == list(range(40))
        assert {r["group_size"] for r in out} == {3}


def test_hot_group_of_null_keys(spark):
    rows = [(None, "same")] * 30
    assert exact_dedup.exact_dedup(docs(spark, rows)).count() == 1


def _family(rng, words, edits, copies):
    base = [rng.choice(words) for _ in range(300)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


def _shingles(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for edits in (0, 1, 2, 4, 6, 9, 12):
        texts += _family(rng, words, edits, 12)
    texts += ["", None, "one two", "One  two", "one two three", "x " * 400, "x " * 30]
    rng.shuffle(texts)
    got = {r[0]: r[1] for r in near_dedup.classes(docs(spark, list(enumerate(texts)))).collect()}
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_block_comparison_finds_what_a_star_misses():
    """Two pairs of near copies in one bucket, none near the smallest member."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(999)]
    texts = [t for _ in range(3) for t in _family(rng, words, 1, 2)]
    hashes = near_dedup._Hashes()
    bags = [np.sort((near_dedup.shingles(t.split(), hashes) >> np.uint64(32)).astype("<u4")).tobytes() for t in texts]
    import pyarrow as pa

    ids = [*range(6), *range(1, 6)]  # at home, then as guests; 0 is the largest component
    table = pa.table(
        {
            "id": pa.array(ids), "comp": pa.array(ids), "band": pa.array([0] * 11), "order": pa.array(ids),
            "guest": pa.array([k > 5 for k in range(11)]), "few": pa.array([i > 0 for i in ids]),
            "sign": pa.array([bytes(480)] * 11), "bag": pa.array([bags[i] for i in ids]),
        }
    )
    a, b = near_dedup._unit_links(table, 0.8)
    assert {frozenset((ids[i], ids[j])) for i, j in zip(a, b)} == {frozenset((0, 1)), frozenset((2, 3)), frozenset((4, 5))}
    assert len(a) == 3


def test_guests_meet_all_members_of_a_bucket(spark, monkeypatch):
    """One bucket of many blocks and groups of guests: all links between components."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    texts = [t for _ in range(20) for t in _family(rng, words, 2, 3)]
    hashes = near_dedup._Hashes()
    bags = [np.sort((near_dedup.shingles(t.split(), hashes) >> np.uint64(32)).astype("<u4")).tobytes() for t in texts]
    n = len(texts)
    comp = [0 if i % 3 == 0 and i < 30 else i for i in range(n)]
    members = spark.createDataFrame([(i, 0, 7) for i in range(n)], "id long, band int, bucket long")
    comps = spark.createDataFrame(list(enumerate(comp)), "id long, comp long")
    sets = spark.createDataFrame([(i, bytes(480), b) for i, b in enumerate(bags)], "id long, sign binary, bag binary")
    got = [frozenset(r) for r in near_dedup._crossed(members, comps, sets, 0.8).collect()]
    want = {
        frozenset((i, j)) for i in range(n) for j in range(i)
        if comp[i] != comp[j] and near_dedup.similarity(bags[i], bags[j]) >= 0.8
    }
    assert set(got) == want and len(got) == len(want) and len(want) > 20


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = np.concatenate([common, rng.integers(0, 2**63, 60).astype(np.uint64)])
    b = np.concatenate([common, rng.integers(0, 2**63, 40).astype(np.uint64)])
    wa, wb = rng.uniform(1, 4, len(a)), rng.uniform(1, 4, len(b))
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    want = 0.0
    for d in common.tolist():
        want += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    got = near_dedup.prob_minhash([(a, wa), (b, wb), (a[:0], wa[:0])], 4000)
    assert abs((got[0] == got[1]).mean() - want) < 0.03 and not got[2].any()


def test_verified_similarity_is_probability_jaccard():
    rng = np.random.default_rng(2)
    bags = [np.sort(rng.integers(0, 40, n).astype("<u4")) for n in (90, 120)]
    (x, y) = [{k: 1 + np.log(c) for k, c in Counter(b.tolist()).items()} for b in bags]
    union, common = x.keys() | y.keys(), x.keys() & y.keys()
    weighted = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in union) for d in common)
    got = near_dedup.similarity(bags[0].tobytes(), bags[1].tobytes())
    assert abs(got - max(weighted, len(common) / len(union))) < 1e-9


def test_near_dedup_keeps_one_of_each(spark):
    rng = random.Random(8)
    copies = _family(rng, [f"u{i}" for i in range(500)], 1, 4)
    rows = [(4, copies[0]), (2, copies[1]), (8, copies[2]), (2, copies[1]), (None, copies[3]), (10, ""), (11, None)]
    out = near_dedup.near_dedup(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "kept", "_sha"]
    ids = sorted((r[0] is None, r[0]) for r in out.select("doc_id").collect())
    assert ids == [(False, 2), (False, 10), (False, 11), (True, None)]
    assert near_dedup.near_dedup(docs(spark, rows).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    comps = spark.range(n).select("id", F.col("id").alias("comp"))
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["comp"] for r in near_dedup.merged(comps, links).collect()} == {0}


def test_lines_repeated_unequally_often_are_linked(spark):
    """Plain Jaccard of 0.8 or more where the weighted similarity is far lower."""
    rng = random.Random(11)
    texts = []
    for k in range(12):
        lines = [" ".join(f"f{k}_{rng.randrange(9999)}" for _ in range(30)) for _ in range(20)]
        texts.append("\n".join(lines))
        texts.append("\n".join(x for i, x in enumerate(lines) for _ in range(100 if i < 8 else 1)))
        texts.append("\n".join(x for i, x in enumerate(lines) for _ in range(1 if i < 12 else 100)))
    hashes = near_dedup._Hashes()
    bags = [np.sort((near_dedup.shingles(t.split(), hashes) >> np.uint64(32)).astype("<u4")).tobytes() for t in texts]
    want = list(range(len(texts)))
    for i in want[:]:
        for j in range(i):
            if near_dedup.similarity(bags[i], bags[j]) >= 0.8:
                want[i] = min(want[i], want[j])
    assert want == [i - i % 3 for i in range(len(texts))]
    got = {r[0]: r[1] for r in near_dedup.classes(docs(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want))
