"""Period runs against all lags, whitening against a dense eigensolver, and
line dedup against plain counts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import cuckoo, line_dedup, period_runs, whitening
from ringfold.llm.queries import LLM_REGISTRY


def all_runs(words):
    """Every run, by comparing all words at every lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            start = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x - start + q >= max(12, 2 * q):
                found.setdefault((start, x - start + q), q)
            x += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _text(rng):
    kind, n = rng.randrange(5), rng.randrange(2, 300)
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    if kind == 1:  # planted periods
        for _ in range(3):
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2 + 1))
            for i in range(a, min(n, a + int(p * rng.uniform(1.8, 6)))):
                words[i] = words[a + (i - a) % p]
    if kind == 2:  # short periods that meet out of step, and their repetition
        d = rng.randrange(1, 5)
        root = [rng.randrange(3) for _ in range(d)]
        words = []
        for _ in range(rng.randrange(1, 4)):
            shift = rng.randrange(d)
            words += [root[(shift + i) % d] for i in range(rng.randrange(1, 120))]
        words *= rng.choice([1, 2, 3])
    if kind == 3:
        one, two = [0], [0, 1]
        while len(two) < n:
            one, two = two, two + one
        words = two
    return [f"w{x}" for x in words]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_all_lags(seed):
    rng = random.Random(seed)
    for _ in range(25):
        docs = [_text(rng) for _ in range(rng.randrange(1, 9))]
        runs, out = period_runs.collapsed([" ".join(d).encode() for d in docs])
        for words, found, text in zip(docs, runs, out):
            want = all_runs(words)
            assert [tuple(r) for r in found.tolist()] == want
            assert text.decode() == collapse(words, want)


def test_runs_of_null_empty_long_and_clashing(spark):
    part = [f"v{i}" for i in range(5000)]
    long = " ".join(["x"] + part * 20 + ["y"])
    rows = [
        (1, None, "r"), (2, "", "r"), (None, " \t\n", "r"), (3, "a b c " * 5, "r"), (3, "a b c " * 5, "r"),
        (4, long, "r"), (5, "z " * 40000, "r"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = period_runs.find(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    found = {(r[0], r[1]): ([tuple(x) for x in r[2]], r[3]) for r in out.collect()}
    assert found[1, None] == found[2, ""] == found[None, " \t\n"] == ([], "")
    assert found[3, "a b c " * 5] == ([], "a b c " * 4 + "a b c")  # ten words
    assert found[4, long] == ([(1, 100000, 5000)], " ".join(["x", *part, "y"]))
    assert found[5, "z " * 40000] == ([(0, 40000, 1)], "z")
    assert out.count() == len(rows)
    assert period_runs.find(df.limit(0)).count() == 0


def test_period_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in LLM_REGISTRY["op11_period_runs"][0](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words = (doc["text"] or "").encode().split()
        h, n = zlib.crc32(str(doc["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        words = [w.decode() for w in words]
        runs, row = all_runs(words), got[doc["doc_id"]]
        assert row["n_runs"] == len(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        told = (row["length"], row["start"], row["period"], row["exponent_milli"])
        assert told == ((-best[0], best[1], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
    assert planted > 5


def _reference(vectors):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    c = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], directions[:, ::-1]


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(7, 7)) * [9, 5, 3, 2, 1, 0.6, 0.3]
    vectors = rng.normal(size=(400, 7)) @ spread + 11
    rows = [(i, [float(v) for v in x], "m") for i, x in enumerate(vectors)]
    bad = [None, [None] * 7, [float("nan")] + [1.0] * 6, [1.0] * 6 + [float("-inf")], [], [1.0] * 5]
    rows += [(None, v, "m") for v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    model = whitening.fit(df)
    x, c, values, directions = _reference(vectors)
    assert model.n == 400 and list(model.sums) == x.sum(axis=0).astype(int).tolist()
    assert np.allclose(model.eigenvalues, values, rtol=1e-9)
    assert np.isclose(model.trace, values.sum(), rtol=1e-12)
    assert np.allclose(np.abs(np.sum(model.components.T * directions, axis=0)), 1, atol=1e-9)
    out = whitening.transform(df, model, 4)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"]
    got = {r["vec_id"]: r for r in out.collect()}
    assert len(got) == 400 and None not in got
    signs = np.sign(np.sum(model.components.T * directions, axis=0))[:4]
    want = c @ directions[:, :4] / np.sqrt(values[:4]) * signs
    for i in range(400):
        assert got[i]["deviation"] == sum((400 * int(a) - s) ** 2 for a, s in zip(x[i], model.sums))
        assert np.allclose(got[i]["whitened"], want[i], atol=1e-8)
    assert whitening.identity_error(df, model, 32) < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    schema = "vec_id long, embedding array<float>"
    twice = spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0])], schema)
    model = whitening.fit(twice)
    rows = whitening.transform(twice, model).collect()
    assert [(r["deviation"], r["whitened"]) for r in rows] == [(0, []), (0, [])]
    assert whitening.identity_error(twice, model, 32) == 0
    nothing = whitening.fit(twice.limit(0))
    assert nothing.n == 0 and whitening.transform(twice, nothing).count() == 0
    # a dependent entry gives no component of its own
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, float(i % 3)]) for i in range(30)], schema)
    assert len(whitening.fit(flat).eigenvalues) == 2


def test_products_are_exact_beyond_doubles():
    z = np.array([[1 << 27, 3], [5, -(1 << 40)], [7, 11]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]
    assert whitening.products(z) == want


def test_cuckoo_filter_keeps_what_was_added():
    rng = random.Random(1)
    for buckets in (1, 2, 64):
        keys = list({rng.getrandbits(64) - (1 << 63) for _ in range(4 * buckets + 20)})
        cells = cuckoo.CuckooFilter(buckets)
        for k in keys:
            cells.add(k)
        again = cuckoo.CuckooFilter(buckets, cells.to_bytes(), cells.extra)

        def held():
            return cuckoo.asked(
                np.array(again.cells, "<u2"), buckets, np.array(again.extra, np.int64), np.array(keys, np.int64)
            )

        assert held().all()
        for k in keys[::2]:
            again.remove(k)
        assert held()[1::2].all()
        for k in keys[1::2]:
            again.remove(k)
        assert not any(again.cells) and not again.extra


def _deduped(texts, known, least):
    counts = Counter()
    for t in known:
        counts.update({k for k in map(_key, (t or "").split("\n")) if k})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not _key(x) or counts[_key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def _key(line):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return lower.strip(" \t\n\v\f\r")


def _texts(rng, n):
    pool = [f"Line {i} Ä" if i % 3 else f" line {i}\t" for i in range(40)]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(0, 12))) for _ in range(n)]
    return texts + [None, "", "\n\n", "\r\nX \n", "lone İ line", "same\nSAME\n same "] + ["twin\nother"] * 7


def _results(index, df):
    cols = ["n_lines", "n_dropped", "kept_text"]
    return sorted(tuple(r) for r in index.dedup(df).select(*cols).collect())


def test_lines_inserted_deleted_and_inserted_again(spark):
    rng = random.Random(4)
    one, two = _texts(rng, 25), _texts(rng, 30)
    schema = "doc_id long, text string, kept_text string"

    def frame(texts):
        return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema).repartition(3)

    first = line_dedup.LineIndex.scratch(spark, min_docs=5, shards=4).insert(frame(one))
    assert _results(first, frame(one)) == _deduped(one, one, 5)
    both = first.insert(frame(two))
    assert _results(both, frame(one)) == _deduped(one, one + two, 5)
    assert _results(both, frame(two)) == _deduped(two, one + two, 5)
    back = both.delete(frame(two))
    assert sorted(back.counts().collect()) == sorted(first.counts().collect())
    assert _results(back, frame(one)) == _deduped(one, one, 5)
    assert _results(back.insert(frame(two)), frame(two)) == _deduped(two, one + two, 5)
    # a filter too large to send answers "maybe" everywhere: the same decisions
    assert sorted(tuple(r)[1:] for r in both.dedup(frame(two), max_bytes=0).drop("doc_id").collect()) == sorted(
        tuple(r)[1:] for r in both.dedup(frame(two)).drop("doc_id").collect()
    )
    assert both.dedup(frame(one)).columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    empty = frame(one).limit(0)
    assert _results(both, empty) == [] and both.insert(empty).counts().count() == both.counts().count()
    with pytest.raises(Exception, match="not in the index"):
        back.delete(frame(["never seen"])).counts().count()


def test_short_keys_and_a_very_long_text(spark):
    long = "\n".join(f"row {i % 700}" for i in range(60_000)) + "\nab\nééé"
    df = spark.createDataFrame([(i, t) for i, t in enumerate([long, "ab\nabc", "AB\n abc ", "ééé"])], "doc_id long, text string")
    index = line_dedup.LineIndex.scratch(spark, min_docs=2, min_chars=3).insert(df)
    out = {r["doc_id"]: r for r in index.dedup(df).collect()}
    assert (out[0]["n_lines"], out[0]["n_dropped"]) == (60_002, 1)
    assert (out[1]["kept_text"], out[2]["kept_text"], out[3]["kept_text"]) == ("ab", "AB", "")


def test_filter_keys_of_hot_lines_are_counted_once_a_document(spark):
    df = spark.range(200).select("id", F.lit("hot\nhot\nHOT ").alias("text"))
    index = line_dedup.LineIndex.scratch(spark).insert(df)
    assert [r["n_docs"] for r in index.counts().collect()] == [200]
    assert index.dedup(df).where("n_dropped = 3 and kept_text = ''").count() == 200
