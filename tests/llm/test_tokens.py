"""Subword operators against the tokenizers library itself."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ringfold.llm import bpe_chunks, packing, subword, token_files
from ringfold.llm.subword import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SHARED = " ".join(f"passage number {i} is shared by all" for i in range(120))
TEXTS = [
    None, "", "a", "  b  ", "it's we'll\n\n  I'd <|endoftext|> x<|startoftext|>y", "x" * 3000,
    "\u00c1rv\u00edzt\u0171r\u0151  t\u00fck\u00f6r", "a\u0301b \u0301c \u0130stanbul \u00b2 \u00bd", "\u65e5\u672c\u8a9e 123 \u0663",
    "\x1c k\u2028l\u00a0m", SHARED, "before " + SHARED, SHARED + " after", "###" * 50, "\t \r\n " * 30,
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "meta", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_library(path):
    enc = Encoder(path)
    texts = [t or "" for t in TEXTS]
    whole = Tokenizer.from_file(path)
    found = enc.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == [ids_of(path, t) for t in texts]
    reused = bpe_chunks.Reuse(enc, {}).encode(texts)
    assert reused == found
    assert enc.decode(found) == [whole.decode(ids_of(path, t), skip_special_tokens=False) for t in texts]


def test_listed_characters_are_those_of_the_categories():
    usual = [c for c in map(chr, range(0x110000)) if not subword.UNUSUAL.search(c)]
    for kind, category in ((subword.LETTER, r"[^\W\d_]"), (subword.OTHER, r"[^\w\s]|_"), ("[0-9]", r"\d"), ("[\t-\r ]", r"\s")):
        assert [c for c in usual if re.match(kind, c)] == [c for c in usual if re.match(category, c)]
    assert not subword.UNUSUAL.search("".join(usual).lower())


def test_words_are_merged_when_looked_up(monkeypatch):
    monkeypatch.setattr(subword, "WORDS", 4)
    enc, merged = Encoder(BYTES), []
    known = enc.known.merged
    monkeypatch.setattr(enc, "word", lambda w: merged.append(w) or known(w))
    enc.known.merged = enc.word
    for text in ("one two one two", "one two three four five", "one six"):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids_of(BYTES, text)
    # beyond its size the memory keeps the half that came first
    assert merged == ["one", " two", " one", " three", " four", " five", " six"]
    assert list(enc.known) == ["one", " two", " six"]


def test_size_of_the_memory_for_words(monkeypatch):
    monkeypatch.setattr(subword, "WORDS", 4)
    monkeypatch.setattr(subword, "LONGEST", 6)
    large, merged = Encoder(BYTES, 8), []
    known = large.known.merged
    large.known.merged = lambda w: merged.append(w) or known(w)
    for text in ("one two three four longer five", "one two three four five", "one longer"):
        assert np.frombuffer(large.encode([text])[0], "<u4").tolist() == ids_of(BYTES, text)
    # more than WORDS stay where an operator asks for it; a longer word never does
    assert merged == ["one", " two", " three", " four", " longer", " five", " longer"]
    assert list(large.known) == ["one", " two", " three", " four", " five"]
    assert subword.encoder(BYTES, 8) is subword.encoder(BYTES, 8) is not subword.encoder(BYTES)


def test_token_files_remember_more_words(spark, monkeypatch):
    df, made = documents(spark), []
    monkeypatch.setattr(token_files, "encoder", lambda path, *most: made.append(most) or Encoder(path, *most))
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = token_files.tokens(df, BYTES, end_id=0)
    batch = pa.record_batch([pa.array(TEXTS), pa.array(range(len(TEXTS)))], ["text", "doc_id"])
    (out,) = run(iter([batch]))
    assert out.column(2).to_pylist() == [ids_of(BYTES, t) + [0] for t in TEXTS]
    assert made == [(token_files.WORDS,)] and token_files.WORDS > subword.WORDS


def test_chunks_are_content_defined():
    cut = bpe_chunks.chunks("one more word " + SHARED)
    assert "".join(cut) == "one more word " + SHARED
    assert len(set(cut) & set(bpe_chunks.chunks(SHARED))) >= len(cut) - 2


def test_shared_chunks_and_digests(spark):
    df = documents(spark)
    assert bpe_chunks.shared_book(df, "text", WORDS)
    rows = {r["doc_id"]: r for r in bpe_chunks.digest(df, WORDS).collect()}
    whole = Tokenizer.from_file(WORDS)
    for i, t in enumerate(TEXTS):
        ids = ids_of(WORDS, t)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = whole.decode(ids, skip_special_tokens=False)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe_chunks.encode_decode(df, WORDS).collect()}
    assert full[10]["ids"] == ids_of(WORDS, SHARED)
    assert bpe_chunks.digest(df.limit(0), WORDS).count() == 0


def test_token_files(spark, tmp_path):
    df = documents(spark, TEXTS + TEXTS[:3]).repartition(3)
    out = str(tmp_path / "tokens")
    token_files.write(df, out, BYTES, end_id=0)
    rows = token_files.digest(spark, out).orderBy("doc_id").collect()
    start = 0
    for i, (t, r) in enumerate(zip(TEXTS + TEXTS[:3], rows)):
        ids = ids_of(BYTES, t) + [0]
        want = (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == want
        start += len(ids)
    file = next(f for f in sorted((tmp_path / "tokens").glob("part-*.parquet")) if pq.read_metadata(f).num_rows)
    group = pq.read_metadata(file).row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    some = token_files.read(spark, out, ["doc_id", "n_tokens"]).where("doc_id >= 3")
    assert "ids" not in some.columns and some.count() == len(TEXTS)


def test_token_files_of_no_rows(spark, tmp_path):
    out = str(tmp_path / "none")
    token_files.write(documents(spark).limit(0), out, BYTES, end_id=0)
    assert token_files.digest(spark, out).count() == 0


def checked(rows, capacity):
    """Sequences are gapless and within the capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing(spark):
    df = documents(spark, TEXTS * 3 + ["word " * 9000])
    rows = packing.pack(packing.pieces(df, WORDS, end_id=1, ids=True)).collect()
    for i, t in enumerate(TEXTS * 3 + ["word " * 9000]):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids_of(WORDS, t) + [1]
        assert [r["start"] for r in own] == [4096 * k for k in range(len(own))]
        assert all(r["length"] == 4096 for r in own[:-1])
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    total = sum(r["length"] for r in rows)
    assert checked(rows, 4096) <= -(-total // 4096) + 1
    assert packing.pack(packing.pieces(df.limit(0), WORDS, end_id=1)).count() == 0


@pytest.mark.parametrize(
    ("lengths", "least"),
    [
        ([5] * 40, 2), ([40] * 30, 15), ([100, 100], 2), ([99] * 7 + [1] * 7, 7),
        (list(range(1, 100)) * 4, 198), ([60, 40, 50, 50, 34, 33, 33] * 9, 27),
    ],
)
def test_packing_near_the_bound(spark, lengths, least):
    df = spark.createDataFrame(
        [(i // 2, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long"
    )
    rows = packing.pack(df, capacity=100).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert checked(rows, 100) <= least * 1.05 + 1


def test_linear_program_finds_complements():
    ways = packing.configurations([60, 40], 100)
    assert packing.optimise([10, 10], ways).sum() == 10


def test_best_fit_on_histograms_equals_one_by_one():
    rng = np.random.default_rng(4)
    items = rng.integers(1, 30, 200).tolist()
    runs, new = packing.best_fit({n: items.count(n) for n in set(items)}, {17: 3, 29: 2}, 50)
    rooms = [17] * 3 + [29] * 2
    for n in sorted(items, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            r, k = min(fits)
            rooms[k] -= n
        else:
            rooms.append(50 - n)
    assert new == len(rooms) - 5
    assert sum(r[2] - r[1] for r in runs) == len(items)
