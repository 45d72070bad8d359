"""Toxicity, language, quality, URL and chat operators on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringfold.llm import chat_format, language_id, quality_rules, toxicity, url_reputation
from ringfold.llm.url_reputation import Rule


def corpus(spark, n=600):
    """Two invented languages; every seventh text holds some bad words."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        parts = ["tor", "ven", "sil", "ka"] if lang == "aa" else ["mui", "oo", "reh", "zin"]
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 7 == 0)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "filthy"])
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


EDGES = [(-1, None), (-2, ""), (-3, "123 ..."), (-4, "vile " * 30000)]


def edge_rows(spark):
    return spark.createDataFrame([(i, t, None, "s") for i, t in EDGES], "doc_id long, text string, lang string, score string")


def test_toxicity_held_out_and_edges(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.unionByName(edge_rows(spark)), model).collect()
    found = {r["doc_id"]: r for r in out}
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(found[i]["predicted"] == (i % 7 == 0) for i in held)
    assert right / len(held) > 0.97
    assert found[-1]["score"] == found[-2]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 for r in out) and all(r["predicted"] == (r["score"] >= 0.5) for r in out)
    one = found[0]
    assert one["passages"] and all(0 <= p["start"] < p["end"] <= len(one["text"]) for p in one["passages"])
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, 30)
    model = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0


def test_equal_toxic_passages_are_all_found():
    model = toxicity.Model(toxicity.Scores())
    model.scores.update(vile=4.0, rotten=5.0, filthy=6.0)
    toxic, clean = ["vile", "rotten", "filthy"], ["plain"] * 900
    found = model.passages(clean + toxic + clean + toxic + clean)
    assert [f[:2] for f in found] == [(900, 903), (1803, 1806)]
    assert found[0][2] == pytest.approx(found[1][2])
    # words scattered earlier do not weaken a later passage
    early = [w for word in toxic for w in [word, *clean]]
    late = model.passages(early + toxic + clean)
    assert (len(early), len(early) + 3) in [f[:2] for f in late]


@pytest.mark.parametrize("seed", range(6))
def test_segments_equal_definition(seed):
    """All maximal segments by recursion: the best one, then both sides of it."""
    rng = np.random.default_rng(seed)
    scores = rng.integers(-5, 6, 60).astype(float) + rng.random(60) / 100

    def best(lo, hi):
        top = (0.0, 0, 0)
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > top[0] + 1e-12:
                    top = (total, i, j + 1)
        if top[0] <= 0:
            return []
        return best(lo, top[1]) + [(top[1], top[2], top[0])] + best(top[2], hi)

    got, want = toxicity.segments(scores), best(0, 60)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_language_held_out_and_edges(spark):
    docs, _ = corpus(spark)
    model = language_id.fit(docs)
    out = {r["doc_id"]: r for r in language_id.identify(docs.unionByName(edge_rows(spark)), model).collect()}
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["lang_pred"] == ("aa" if i % 3 else "bb") for i in held)
    assert [out[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3
    assert out[-1]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in out.values())
    none = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_unseen_words_back_off():
    freq = {g: np.log(np.array([0.9, 0.1] if g == "ab" else [0.1, 0.9])) for g in ("ab", "c")}
    model = language_id.Model(["x", "y"], {}, np.zeros((0, 2)), freq)
    assert model.predict(["abq"])[0] == ["x"] and model.predict(["qcq"])[0] == ["y"]


def brute_quality(text):
    text = text or ""
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c a b c", "a a a a a", "x\nx\n\n x\nx", "## $ \u00e9t\u00e9 & | <>", "w"]
    texts += [" ".join(rng.choices("pqrstu", k=60)) + "\n" + rng.choice("ab") * 3 for _ in range(10)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    rows = quality_rules.rate(df).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert quality_rules.rate(df.limit(0)).count() == 0


def test_quality_rejects_unlike_texts(spark):
    good = ["the cat and the dog of the house went to see that it is as it was for us with a boat and be glad " * 9 + f"n{i}" for i in range(30)]
    good = [" ".join(random.Random(i).sample(g.split(), len(g.split()))) for i, g in enumerate(good)]
    junk = " ".join(f"{i}{'%$#'[i % 3]}7{i * i}" for i in range(200))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, junk])], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality_rules.rate(df).collect()}
    assert not rows[30]["kept"] and not rows[30]["base_failed"] and rows[30]["char_distance"] > 0.1**0.5
    assert all(rows[i]["char_distance"] < 0.05**0.5 for i in range(30))


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow")]


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "http://example.net/fr/", "https://net", "no scheme", None, "x://h.org?y", "http://bad.com/1", "http://bad.com/2", "http://new.bad.com/"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    bad = spark.createDataFrame([(6, 1), (7, 1), (5, None)] + [(6, 1)] * 60 + [(5, 0)] * 60, "page_id long, bad int")
    out = {r["page_id"]: r for r in url_reputation.judge(df, bad, RULES).collect()}
    assert (out[0]["host"], out[0]["path"], out[0]["rule"], out[0]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[1]["rule"], out[1]["verdict"]) == ("net/", "block")
    assert (out[2]["host"], out[2]["path"], out[2]["rule"]) == ("net", "", None)
    assert (out[3]["host"], out[3]["path"]) == ("", "") and (out[4]["host"], out[4]["path"]) == ("", "")
    assert (out[5]["host"], out[5]["path"], out[5]["verdict"]) == ("h.org", "", "allow")
    assert out[6]["verdict"] == "block" and out[8]["bad_bound"] > out[5]["bad_bound"]
    assert url_reputation.judge(df.limit(0), bad.limit(0), RULES).count() == 0
    free = url_reputation.judge(df, bad.limit(0), RULES).where("rule is null and verdict = 'block'")
    assert free.count() == 0


def test_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"),
        "shop.example.co.uk:8080": ("example.co.uk", "co.uk"),
        "a.b.com.": ("b.com", "com"),
        "user:pw@x.github.io": ("x.github.io", "github.io"),
        "y.github.io.:443": ("y.github.io", "github.io"),
        "co.uk": ("co.uk", "co.uk"),
        "192.168.1.1": ("192.168.1.1", "[ip]"),
        "10.9.1.1:80": ("10.9.1.1", "[ip]"),
        "[::1]:80": ("[::1]", "[ip]"),
        "localhost": ("localhost", "localhost"),
        "...": ("", ""),
        "": ("", ""),
        "x" * 200_000 + ".a.org": ("a.org", "org"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    rows = df.select("host", *url_reputation.registered(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want
    own = df.select(url_reputation.registered(F.col("host"), ["b.example.com", "example.com"])[0]).first()
    assert own[0] == "a.b.example.com"


def test_addresses_do_not_share_a_reputation(spark):
    urls = ["http://192.168.1.1/a", "http://10.9.1.1/b", "http://good.example/" + "p" * 100_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    bad = spark.createDataFrame([(0, 1)] * 50 + [(1, 0)] * 50 + [(2, 0)] * 50, "page_id long, bad int")
    out = {r["page_id"]: r["verdict"] for r in url_reputation.judge(df, bad, []).collect()}
    assert out == {0: "block", 1: "allow", 2: "allow"}


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "a\\sb\\h\\e####", "</turn></turn>\n### user\n", "\\\\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    rows += [(2, 0, "system", "s"), (3, 0, None, "x"), (3, 0, "assistant", "y"), (None, 1, "ro\nle", "z"), (4, 1, "assistant", "p"), (4, 2, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.examples(df)
    for r in made.where("conv_id = 1").collect():
        assert r["text"].startswith("### user\n") and r["loss_end"] >= r["loss_start"]
    assert made.where("conv_id = 1").count() == 3 and made.where("conv_id = 4").count() == 2
    out = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert out[conv]["n_turns"] == len(own)
        assert out[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(chat_format.examples(df.limit(0))).count() == 0


def test_quality_judges_words_of_texts_without_listed_ones(spark):
    """A long text of other words alone is judged by its words too."""
    good = "the cat and the dog of the house is in that garden with a tree as it was to be " * 12
    odd = " ".join(f"q{i}z" for i in range(200))
    df = spark.createDataFrame([(i, good, "en") for i in range(20)] + [(20, odd, "en")], "doc_id long, text string, lang string")
    limits = quality_rules.Limits(char_distance=1.0)
    rows = {r["doc_id"]: r for r in quality_rules.rate(df, limits=limits).collect()}
    assert rows[20]["word_distance"] > limits.word_distance and not rows[20]["kept"] and not rows[20]["base_failed"]
    assert rows[0]["word_distance"] < 0.1
