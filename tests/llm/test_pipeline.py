"""The pipeline's stages one by one on a small documents table."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_small_table(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        parts = ["tor", "ven", "sil"] if i % 3 else ["mui", "reh", "zin"]
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(120)]
        if i % 7 == 0:
            for k in range(0, 120, 20):
                words[k] = rng.choice(["vile", "rotten", "filthy"])
        rows.append((i, " ".join(words), "aa" if i % 3 else "bb", "s", 0))
        labels.append((i, 1, int(i % 7 == 0)))
    clean = next(r for r in rows if r[0] % 7)
    near = clean[1].split()
    near[50] = "changed"
    rows += [(1000, clean[1], "aa", "s", 0), (1001, " ".join(near), "aa", "s", 0), (1002, "12 34 !", "aa", "s", 0)]
    rows += [(1003, None, None, None, None), (1003, None, None, None, None)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r[0] for r in docs.select("doc_id").collect()}
    kept = {i for i in range(300) if i % 7}
    assert len(left["toxicity"] & kept) >= 0.98 * len(kept)
    assert len(left["toxicity"] - kept - {1000, 1001, 1002, 1003}) <= 3
    assert not left["language_id"] & {1002, 1003} and {1000, 1001} <= left["language_id"]
    assert 1000 not in left["exact_dedup"] and 1001 in left["exact_dedup"]
    assert left["near_dedup"] == left["exact_dedup"] - {1001}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r[0] for r in out.select("doc_id").collect()} == left["near_dedup"]
