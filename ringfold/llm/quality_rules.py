"""Quality rules by divergence from language references.

Base rules count words, symbols, repeated lines and repeated three-word windows.
The method's own verdict compares two histograms of a text, its character
classes and its words (the common ones, and all others together), with those of
each language by the Jensen-Shannon distance (the root of the divergence to base
2, so 0 to 1). A text is kept if it is close to one language in both; texts too
short for a histogram, by their characters or words, are not judged by it.

The references are sums over all rows of a language. They have one row for each
language of ``COMMON``, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, unpacked

SPACE = "[\\x20\\x09-\\x0D]+"
# The most frequent function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf".split(),
    "en": "the of and to in is that it as for with be".split(),
    "es": "de la que el en y a los se del las por".split(),
    "fr": "de la le et les des en un du une que est".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
CELLS = len(WORDS) + 1
CLASSES = ["lower", "space", "upper", "digit", "symbol", "accented", "other"]
ADDED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "char_distance", "word_distance", "kept",
]


@dataclass(frozen=True)
class Limits:
    """Largest distance kept, and the least size of a text to judge.

    The distances lie above those of the good labelled texts of the test tables."""

    char_distance: float = 0.27
    word_distance: float = 0.28
    min_chars: int = 200
    min_words: int = 50


def repeated_positions(grams: Column) -> Column:
    """Distinct words in three-word windows that occur twice or more.

    ``grams`` are the windows' hashes by position. Only rows with a repeated
    window sort their windows; equal neighbours of the sorted (window, position)
    pairs are repeated.
    """
    pairs = F.sort_array(
        F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    )

    def repeated(s: Column) -> Column:
        again = F.filter(
            s,
            lambda x, i: F.get(s, i - 1)["g"].eqNullSafe(x["g"])
            | F.get(s, i + 1)["g"].eqNullSafe(x["g"]),
        )
        at = F.flatten(
            F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        )
        return F.size(F.array_distinct(at))

    # a one-element array binds the sorted pairs, so they are sorted once
    return F.transform(F.array(pairs), repeated)[0]


def features(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Counts and histograms of every text, beside the columns ``carry``
    (all columns by default) packed in ``_row``."""
    kept = df if carry is None else df.select(*carry)
    one = df.select(
        packed(kept), F.coalesce(F.col(text), F.lit("")).alias("_t")
    ).select(
        "_row",
        "_t",
        F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("_l"),
        F.regexp_replace("_t", "[a-z]+", "").alias("_rest"),
    )
    seen = [w for word in WORDS for w in (word, word.capitalize())]
    two = one.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") > 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("_g"),
        F.lower(F.concat(F.lit(" "), F.array_join(F.filter("_w", lambda w: w.isin(seen)), "  "), F.lit(" "))).alias("_c"),
        F.length("_t").alias("_n"),
        F.length("_rest").alias("_nr"),
        F.regexp_replace("_rest", SPACE, "").alias("_rest"),
    )
    rest = F.col("_rest")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(rest, pattern, ""))

    common = F.array(*[
        ((F.length("_c") - F.length(F.replace(F.col("_c"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("double")
        for w in WORDS
    ])
    three = two.select(
        "_row",
        "n_words",
        "word_chars",
        left("[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.when(F.size("_g") == F.size(F.array_distinct("_g")), F.lit(0))
        .otherwise(repeated_positions(F.col("_g"))).cast("long").alias("n_repeat_words"),
        left("[^A-Z]+").alias("_up"),
        left("[^0-9]+").alias("_dg"),
        left("[\\x00-\\x7F]+").alias("_ac"),
        F.length("_rest").alias("_left"),
        "_n",
        "_nr",
        common.alias("_words"),
    )
    lower = F.col("_n") - F.col("_nr")
    classes = [
        lower,
        F.col("_nr") - F.col("_left"),
        F.col("_up"),
        F.col("_dg"),
        F.col("n_symbols"),
        F.col("_ac"),
        F.col("_left") - F.col("_up") - F.col("_dg") - F.col("n_symbols") - F.col("_ac"),
    ]
    return three.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*[c.cast("double") for c in classes]).alias("_chars"),
        # the last cell: all other words
        F.concat(
            "_words", F.array(F.col("n_words") - F.aggregate("_words", F.lit(0.0), lambda a, x: a + x))
        ).alias("_words"),
    )


def references(found: DataFrame, lang: Column) -> dict[str, tuple[list[float], list[float]]]:
    """Summed histograms of each language of ``COMMON``: at most that many rows."""
    rows = (
        found.where(lang.isin(*COMMON))
        .groupBy(lang.alias("lang"))
        .agg(
            *[F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))],
            *[F.sum(F.col("_words")[i]).alias(f"w{i}") for i in range(CELLS)],
        )
        .collect()
    )
    return {
        r["lang"]: (
            [r[f"c{i}"] for i in range(len(CLASSES))],
            [r[f"w{i}"] for i in range(CELLS)],
        )
        for r in rows
    }


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms given as counts: the root of
    the divergence, base 2."""
    total = sum(reference)
    if total <= 0:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(x / total) for x in reference])
    size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    share = F.transform(F.array(size), lambda s: F.transform(counts, lambda x: x / s))[0]
    found = F.aggregate(F.zip_with(share, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(found, F.lit(0.0)))


def nearest(counts: Column, refs: list[list[float]]) -> Column:
    """The smallest distance to a reference; null without one."""
    found = [distance(counts, r) for r in refs]
    if not found:
        return F.lit(None).cast("double")
    return F.least(*found) if len(found) > 1 else found[0]


def judged(
    found: DataFrame, columns: list[str], refs: dict, limits: Limits = Limits()
) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    chars = F.aggregate("_chars", F.lit(0.0), lambda a, x: a + x)
    told = found.select(
        "*",
        base.alias("base_failed"),
        F.when(chars >= max(limits.min_chars, 1), nearest(F.col("_chars"), [c for c, _ in refs.values()])).alias("char_distance"),
        F.when(F.col("n_words") >= max(limits.min_words, 1), nearest(F.col("_words"), [w for _, w in refs.values()])).alias("word_distance"),
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limits.char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= limits.word_distance
    )
    return told.select(
        *unpacked(columns, ADDED),
        *ADDED[:-1],
        (~F.col("base_failed") & near).alias("kept"),
    )


def rate(df: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Every row with its counts, distances and verdict.

    A null text counts as empty; it has no word, so the base rules reject it.
    Rows of a null or unknown language count in no reference but are judged
    against all. Without any reference (no row of a known language) only the
    base rules decide. Added columns replace input columns of their names.
    Texts are read twice: for the references and for the verdicts.
    """
    found = features(df, text)
    refs = references(found, F.col("_row").getField(lang))
    return judged(found, df.columns, refs, limits)
