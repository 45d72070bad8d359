"""Language identification by words first, then by shorter and shorter grams.

A word met in training has a log frequency in every language. A word that was
not is scored by its longest known character n-grams: those of four characters
(the word's edges marked), else of three, two or one. A text's log frequencies
are added up; the best language is predicted, with its posterior share as score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc32_mod, packed, unpacked
from .subword import blocks

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
# Labelled rows that the fit reads, about.
MAX_ROWS = 12_000
# Unseen words whose scores a Python worker remembers.
REMEMBERED = 200_000
SMOOTHING = 0.5
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-case words; empty if the text has no letter."""
    found = WORD.findall(text.lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def grams(word: str, size: int) -> list[str]:
    marked = f"<{word}>" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    rows: np.ndarray  # log frequency by word and language
    grams: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = dict(self.words)
        self.table = self.rows

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's longest known n-grams."""
        for size in range(LONGEST, 0, -1):
            found = [self.grams[g] for g in grams(word, size) if g in self.grams]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if len(self.known) > len(self.words) + REMEMBERED:
            self.forget()
        new = list(set().union(*split).difference(self.known))
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            self.table = np.concatenate([self.table, np.array([self.unseen(w) for w in new])])
        langs, scores = [], []
        for words in split:
            if not words or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            # in blocks, so a long text's rows are not gathered at once
            total = sum(
                self.table[at[i : i + 65536]].sum(axis=0) for i in range(0, len(at), 65536)
            )
            best = int(np.argmax(total))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    max_rows: int = MAX_ROWS,
    folds: int = 4,
    held: int = 2,
) -> Model:
    """Fit on rows with a language whose crc32(key) mod ``folds`` is not ``held``.

    About ``max_rows`` of them are read, chosen by the hash of the key. Words
    and n-grams seen twice or more make the model, so its size is bounded by
    the sample's. Without any such row every prediction is ``und``.
    """
    rows = docs.where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & (crc32_mod(F.col(key), folds) != held)
    ).select(key, text, lang)
    total = rows.select(key).count()
    share = F.pmod(F.xxhash64(F.lit(5), key), F.lit(1_000_000))
    chosen = rows.where(share < 1_000_000 * max_rows / max(total, 1)).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update([(own, w) for w in words_of(t)])
            yield _rows(seen)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for own, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for size in range(1, LONGEST + 1):
                    seen.update([(own, g) for g in grams(w, size)])
            yield _rows(seen)

    schema = "lang string, term string, n long"
    words = (
        chosen.mapInArrow(counted, schema).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    )
    letters = (
        words.select("lang", "term")
        .mapInArrow(spelled, schema)
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"))
    )
    by_word = words.where("n > 1").toPandas()
    by_gram = letters.where("n > 1").toPandas()
    langs = sorted(set(by_word["lang"]) | set(by_gram["lang"]))
    names, table = _log_frequencies(by_word, langs)
    gram_names, gram_table = _log_frequencies(by_gram, langs)
    return Model(langs, dict(zip(names, range(len(names)))), table, dict(zip(gram_names, gram_table)))


def _rows(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([k[0] for k in seen], pa.string()),
            pa.array([k[1] for k in seen], pa.string()),
            pa.array(list(seen.values()), pa.int64()),
        ],
        ["lang", "term", "n"],
    )


def _log_frequencies(counts, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Terms and their smoothed log frequency in each language."""
    names = sorted(set(counts["term"]))
    place = dict(zip(names, range(len(names))))
    table = np.zeros((len(names), len(langs)))
    row = counts["term"].map(place).to_numpy(int)
    column = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    table[row, column] = counts["n"].to_numpy(float)
    total = table.sum(axis=0) + SMOOTHING * max(len(names), 1)
    return names, np.log(table + SMOOTHING) - np.log(total)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0. All columns
    are kept, but those named as the added ones are replaced. An empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in texts:
            texts = [t or "" for t in column.to_pylist()]
            langs, scores = [], []
            for i, j in blocks(texts):
                found = m.predict(texts[i:j])
                langs += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["lang_pred", "score"],
            )

    rows = docs.select(packed(docs), told(F.col(text)).alias("_told"))
    return rows.select(
        *unpacked(docs.columns, ["lang_pred", "score"]),
        F.col("_told.lang_pred").alias("lang_pred"),
        F.col("_told.score").alias("score"),
    )
