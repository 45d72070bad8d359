"""Toxic passages by maximum-scoring segment search.

Each word has the log-odds of standing in a toxic rather than a clean text,
estimated from presence counts under Dirichlet priors: a word's prior is centred
on the log-odds of its first six letters, theirs on that of the first four, and
theirs on zero, so unseen forms of a known stem score too. A log-odds that is
within some standard errors of both zero and its prior takes the prior's value.
Less a small drift, the scores of all words of a text, repeated ones included, are
searched in linear time for all maximal segments. Scores of the best segment in
clean texts follow an extreme-value law; its location and scale, fitted on texts
that the counts have not seen, turn a segment's score and the text's length into a
significance. A text's evidence is summed over its significant passages and
mapped to a probability by a logistic curve fitted on the same texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc32_mod, packed, unpacked

WORD = re.compile(r"[^\W\d_]+")
STEMS = (6, 4)
# Labelled rows that the fit reads, about, for each class.
MAX_ROWS = 10_000
PRIOR = 2.0
DRIFT = 0.05
# Standard errors by which a log-odds must differ from its prior to be used.
TOLD = 2.5
SIGNIFICANT = 0.01
EULER = 0.5772156649


def words_of(text: str) -> list[str]:
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


@dataclass
class Scores(dict):
    """Log-odds by word, less the drift; unseen words take their stem's."""

    stems: dict[str, float] = field(default_factory=dict)

    def __missing__(self, word: str) -> float:
        for size in STEMS:
            if len(word) > size and word[:size] in self.stems:
                return self.stems[word[:size]]
        return -DRIFT


def stems_of(word: str) -> list[str]:
    return [word[:size] for size in STEMS if len(word) > size]


def log_odds(counts: pd.DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of words and of stems from (term, toxic, clean) presence counts.

    Terms are ``w`` or ``s`` and the word or stem. Each count gets pseudo-counts
    that alone would give the prior's log-odds.
    """
    is_word = (counts["term"].str[0] == "w").to_numpy()
    name = counts["term"].str[1:]
    size = name.str.len().to_numpy()
    toxic, clean = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    all_toxic, all_clean = toxic[is_word].sum() + 1.0, clean[is_word].sum() + 1.0
    base = math.log(all_toxic / all_clean)
    found: dict[str, float] = {}

    def told(at: np.ndarray) -> dict[str, float]:
        """Log-odds that differ from zero or from their prior."""
        names = name[at].tolist()
        prior = np.array([next((found[g] for g in stems_of(w) if g in found), 0.0) for w in names])
        share = 1 / (1 + np.exp(-(prior + base)))
        t, c = toxic[at] + PRIOR * share, clean[at] + PRIOR * (1 - share)
        score = np.log(t / c) - base
        error = TOLD * np.sqrt(1 / t + 1 / c)
        differs = (np.abs(score) > error) | (np.abs(score - prior) > error)
        return {w: x for w, x, d in zip(names, score.tolist(), differs) if d}

    for length in sorted(STEMS):
        found.update(told(~is_word & (size == length)))
    words = told(is_word)
    return (
        {w: x - DRIFT for w, x in words.items()},
        {g: x - DRIFT for g, x in found.items()},
    )


def scored(words: list[str], scores: dict[str, float]) -> np.ndarray:
    """The words' scores, those of every occurrence."""
    return np.fromiter(map(scores.__getitem__, words), float, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), in linear time.

    Runs of positive and of other scores are summed first. Each candidate keeps
    the cumulative sums before and after it and a link to the nearest earlier
    candidate with a smaller sum before, as in the published algorithm.
    """
    positive = scores > 0
    if not positive.any():
        return []
    starts = np.flatnonzero(np.diff(positive, prepend=~positive[0]))
    sums = np.add.reduceat(scores, starts)
    ends = np.append(starts[1:], len(scores))
    after = np.cumsum(sums)
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    link: list[int] = []
    first = 0 if positive[0] else 1
    for k in range(first, len(starts), 2):
        low, high = float(after[k] - sums[k]), float(after[k])
        begin, end = int(starts[k]), int(ends[k])
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                left.append(low)
                right.append(high)
                span.append((begin, end))
                link.append(j)
                break
            low, begin = left[j], span[j][0]
            del left[j:], right[j:], span[j:], link[j:]
    return [(b, e, r - s) for (b, e), s, r in zip(span, left, right)]


@dataclass
class Model:
    scores: Scores
    rate: float = 1.0
    location: float = 0.0
    scale: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Significant segments (from word, to word, evidence).

        Evidence is minus the log of the expected number of such segments in a
        clean text of this length."""
        if not words:
            return []
        found = segments(scored(words, self.scores))
        least = -math.log(SIGNIFICANT)
        out = []
        for begin, end, score in found:
            z = (self.rate * score - math.log(len(words)) - self.location) / self.scale
            if z > least:
                out.append((begin, end, z))
        return out

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * math.log1p(evidence))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        gradient = a.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _rate(values: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum p exp(rate * score) = 1, 1 if there is none."""
    p = n / max(n.sum(), 1)
    if not len(values) or values.max() <= 0 or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return (low + high) / 2 or 1.0


def sample(labelled: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of each class at most, by the hash of their key."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    keep = F.lit(False)
    for toxic, n in sizes.items():
        share = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1_000_000)) < 1_000_000 * max_rows / n
        keep = keep | ((F.col("toxic") == toxic) & share)
    return labelled.where(keep)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    max_rows: int = MAX_ROWS,
    folds: int = 5,
) -> Model:
    """Fit on labelled rows whose crc32(key) mod ``folds`` is not 0.

    A bounded sample of labelled rows is read, about ``max_rows`` of a class.
    The last fold calibrates, the others are counted. Null labels, keys and
    texts are left out. Without labels of both classes every text gets the
    smoothed share of toxic labels.
    """
    fold = crc32_mod(F.col(key), folds)
    chosen = sample(
        labels.where(F.col("toxic").isin(0, 1) & (fold != 0)).select(key, "toxic"), key, max_rows
    )
    # bounded by max_rows for each class, whatever the size of the tables
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(
        text, "toxic", (fold == folds - 1).alias("held")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(words_of(t or ""))
                seen[label].update(["w" + w for w in own])
                seen[label].update({"s" + g for w in own for g in stems_of(w)})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.record_batch(
                [
                    pa.array(terms, pa.string()),
                    pa.array([seen[1][t] for t in terms], pa.int64()),
                    pa.array([seen[0][t] for t in terms], pa.int64()),
                ],
                ["term", "toxic", "clean"],
            )

    counts = (
        rows.where("not held")
        .select(text, "toxic")
        .mapInArrow(counted, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic + clean > 1")
        .toPandas()
    )
    words, stems = log_odds(counts)
    scores = Scores(stems)
    scores.update(words)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found, levels = [], [], Counter()
            for t in batch.column(0).to_pylist():
                own = words_of(t or "")
                s = scored(own, scores)
                lengths.append(len(own))
                found.append([x[2] for x in segments(s)] if len(own) else [])
                values, n = np.unique(np.round(s, 1), return_counts=True)
                levels.update(dict(zip(values.tolist(), n.tolist())))
            # the batch's score levels are given with its first row
            empty = [[] for _ in lengths[1:]]
            yield pa.record_batch(
                [
                    batch.column(1),
                    pa.array(lengths, pa.int64()),
                    pa.array(found, pa.list_(pa.float64())),
                    pa.array([list(levels.keys()), *empty][: len(lengths)], pa.list_(pa.float64())),
                    pa.array([list(levels.values()), *empty][: len(lengths)], pa.list_(pa.int64())),
                ],
                ["toxic", "n", "found", "level", "times"],
            )

    seen = (
        rows.where("held")
        .select(text, "toxic")
        .mapInArrow(scanned, "toxic int, n long, found array<double>, level array<double>, times array<long>")
        .toPandas()
    )
    return calibrated(scores, seen)


def calibrated(scores: Scores, seen: pd.DataFrame) -> Model:
    """Extreme-value and logistic calibration on scanned texts."""
    model = Model(scores)
    y = seen["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        model.intercept = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 4.5))
        return model
    levels: Counter = Counter()
    for value, n in zip(seen["level"], seen["times"]):
        levels.update(dict(zip(value, n)))
    model.rate = _rate(np.array(list(levels.keys())), np.array(list(levels.values()), float))
    best = np.array([max(f, default=0.0) if len(f) else 0.0 for f in seen["found"]])
    n = np.maximum(seen["n"].to_numpy(float), 1)
    clean = (model.rate * best - np.log(n))[y == 0]
    model.scale = max(float(np.std(clean)) * math.sqrt(6) / math.pi, 0.25)
    model.location = float(np.mean(clean)) - EULER * model.scale
    least = -math.log(SIGNIFICANT)
    evidence = []
    for f, size in zip(seen["found"], n):
        z = (model.rate * np.array(f, float) - math.log(size) - model.location) / model.scale
        evidence.append(z[z > least].sum())
    model.intercept, model.slope = _logistic(np.log1p(np.array(evidence)), y)
    return model


def score(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    passages: bool = True,
) -> DataFrame:
    """Every row with score, predicted and (if asked for) its toxic passages.

    Passages are (start, end, evidence) in code points of the text. Null and
    empty texts have no evidence and get the probability of such texts. All
    columns are kept, but those named as the added ones are replaced. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(
        "struct<score:double,passages:array<struct<start:int,end:int,evidence:double>>>"
    )
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        kind = pa.list_(
            pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])
        )
        for column in texts:
            scores, spans = [], []
            for t in column.to_pylist():
                found = m.passages(words_of(t)) if t else []
                scores.append(m.probability(sum(z for _, _, z in found)))
                if found and passages:
                    at = [(w.start(), w.end()) for w in WORD.finditer(t)]
                    found = [
                        {"start": at[b][0], "end": at[e - 1][1], "evidence": z}
                        for b, e, z in found
                    ]
                spans.append(found if passages else [])
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(spans, kind)], ["score", "passages"]
            )

    added = ["score", "predicted"] + (["passages"] if passages else [])
    rows = docs.select(packed(docs), told(F.col(text)).alias("_told"))
    return rows.select(
        *unpacked(docs.columns, added),
        F.col("_told.score").alias("score"),
        (F.col("_told.score") >= 0.5).cast("int").alias("predicted"),
        *([F.col("_told.passages").alias("passages")] if passages else []),
    )
