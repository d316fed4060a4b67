"""Transcript quality: clean text, count repeats, list issues.

Everything is per row and needs no shuffle. The token array is its own projected column, so
the measures share it. A verdict takes all measures at once: a small helper counts them in one
pass over the words, since lambda functions are interpreted and took several times as long.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.functions import fixed_values as fv
from chatweave.functions.text import bind, strip
from chatweave.plans.session import ship_package

# These go: byte-order mark, zero-width space, and controls but \t, \n and \r, which becomes \n.
_DROPPED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FEFF}\x{200B}]+"
_WORD, _SENTENCE_END = re.compile(fv.WORD), re.compile(fv.SENTENCE_END)


def normalize_text(col: Column) -> Column:
    """Cleaned text; null is empty. The patterns match only what changes, and cleaned text stays as it is."""
    text = F.regexp_replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r"), F.lit("\n")), _DROPPED, "")
    text = F.regexp_replace(text, r" [ \t]+|\t[ \t]*", " ")
    return strip(F.regexp_replace(text, r" +\n *|\n +", "\n"))


def tokens(col: Column) -> Column:
    """Lower-case words. Words hold no space, so one lower-casing of the joined text will do."""
    joined = F.array_join(F.regexp_extract_all(col, F.lit(fv.WORD), F.lit(0)), " ")
    # Splitting '' gives one empty item, which no word can be.
    return F.array_remove(F.split(F.lower(joined), " "), "")


def longest_run(items: Column) -> Column:
    """Length of the longest stretch of equal neighbours in an array; 0 when empty.

    Keeps the positions where a new value starts; the widest gap between two of them is the answer.
    """

    def measure(arr: Column) -> Column:
        n = F.size(arr)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(arr, i) != F.get(arr, i - 1))
        )
        gaps = bind(
            starts,
            lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n)), lambda x, y: y - x),
        )
        return F.when(n > 0, F.array_max(gaps)).otherwise(F.lit(0))

    return bind(items, measure)


def ngrams(items: Column, n: int) -> Column:
    """Space-joined runs of ``n`` items; empty when there are fewer."""

    def build(arr: Column) -> Column:
        count = F.size(arr) - (n - 1)
        grams = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.concat_ws(" ", *[F.get(arr, i + k) for k in range(n)]),
        )
        return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))

    return bind(items, build)


def sentences(text: Column) -> Column:
    """Word-normalised sentences of at least three words."""
    parts = F.transform(F.split(text, fv.SENTENCE_END), lambda p: F.regexp_extract_all(p, F.lit(fv.WORD), F.lit(0)))
    long_enough = F.filter(parts, lambda w: F.size(w) >= fv.SENTENCE_TOKENS_MIN)
    return F.transform(long_enough, lambda w: F.lower(F.array_join(w, " ")))


def max_repeat(items: Column) -> Column:
    """How often the most frequent item of an array occurs: equal items are neighbours once sorted."""
    return longest_run(F.sort_array(items))


def with_tokens(df: DataFrame, text: str, clean: str = "_clean", words: str = "_tokens") -> DataFrame:
    return df.withColumn(clean, normalize_text(F.col(text))).withColumn(words, tokens(F.col(clean)))


def token_measures(df: DataFrame, words: str = "_tokens") -> DataFrame:
    """token_count, _ratio (unrounded), max_token_run."""
    n = F.size(words)
    return (
        df.withColumn("token_count", n)
        .withColumn(
            "_ratio",
            F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(F.lit(0.0)),
        )
        .withColumn("max_token_run", longest_run(F.col(words)))
    )


def tail_issues(clean: Column) -> list[Column]:
    tail = F.right(clean, F.lit(fv.TAIL_CHARS))
    symbols = F.regexp_count(tail, F.lit(fv.TAIL_SYMBOL))
    unusual = F.regexp_count(tail, F.lit(fv.TAIL_UNUSUAL_SYMBOL))
    return [
        F.when(F.contains(tail, F.lit("\ufffd")), "trailing_replacement_char"),
        F.when(tail.rlike(fv.PUNCTUATION_LOOP), "trailing_punctuation_loop"),
        F.when(
            (symbols >= fv.TAIL_SYMBOLS_MIN) & (unusual / symbols >= fv.TAIL_UNUSUAL_SHARE),
            "trailing_symbol_noise",
        ),
    ]


def body_issues() -> list[Column]:
    return [
        F.when(
            (F.col("token_count") >= fv.UNIQUE_RATIO_TOKENS_MIN) & (F.col("_ratio") < fv.UNIQUE_RATIO_LIMIT),
            "low_unique_token_ratio",
        ),
        F.when(F.col("max_token_run") >= fv.TOKEN_RUN_LIMIT, "repeated_token_loop"),
        F.when(
            (F.col("token_count") >= fv.PHRASE_TOKENS_MIN)
            & (F.col("max_phrase_repeat") >= fv.PHRASE_REPEAT_LIMIT),
            "repeated_phrase_loop",
        ),
        F.when(F.col("max_sentence_repeat") >= fv.SENTENCE_REPEAT_LIMIT, "repeated_sentence_loop"),
    ]


def _measured(text: str) -> tuple[int, float, int, int, int]:
    """token_count, _ratio, max_token_run, max_phrase_repeat and max_sentence_repeat of a cleaned text."""
    found = [w for w in map(_WORD.findall, _SENTENCE_END.split(text)) if w]  # no word goes over a sentence's end
    if not found:
        return 0, 0.0, 0, 0, 0
    lowered = [" ".join(w).lower() for w in found]
    words = " ".join(lowered).split(" ")
    longest = run = 1
    for before, word in zip(words, words[1:]):
        run = run + 1 if word == before else 1
        if run > longest:
            longest = run
    phrases = Counter(zip(words, words[1:], words[2:]))
    said = Counter(s for s, w in zip(lowered, found, strict=True) if len(w) >= fv.SENTENCE_TOKENS_MIN)
    return len(words), len(set(words)) / len(words), longest, max(phrases.values(), default=0), max(said.values(), default=0)


_MEASURES = ["token_count", "_ratio", "max_token_run", "max_phrase_repeat", "max_sentence_repeat"]
_MEASURE_TYPES = "token_count int, _ratio double, max_token_run int, max_phrase_repeat int, max_sentence_repeat int"


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_measured(t) for t in texts], columns=_MEASURES)


def assess_quality(df: DataFrame, text: str = "text", out: str = "quality", normalized: bool = False) -> DataFrame:
    """Add ``out``: struct<ok, issues, metrics>. ``normalized``: the text went through ``normalize_text``.

    The phrase measure is the largest count over runs of 3, 4 and 5 words. A longer run occurs
    no more often than the 3 words it starts with, so counting 3-word runs gives the same number.
    """
    ship_package(df.sparkSession)
    clean = F.col(text) if normalized else normalize_text(F.col(text))
    measured = df.withColumn("_clean", clean).withColumn("_measures", F.pandas_udf(_measures, _MEASURE_TYPES)("_clean"))
    measured = measured.withColumns({c: F.col(f"_measures.{c}") for c in _MEASURES})
    empty = F.col("_clean") == ""
    issues = F.when(empty, F.array(F.lit("empty_transcript"))).otherwise(
        F.array_compact(F.array(*tail_issues(F.col("_clean")), *body_issues()))
    )

    def unless_empty(col: Column) -> Column:
        return F.when(~empty, col)

    metrics = F.struct(
        F.length("_clean").alias("char_count"),
        F.col("token_count"),
        unless_empty(F.round("_ratio", 4)).alias("unique_token_ratio"),
        unless_empty(F.col("max_token_run")).alias("max_token_run"),
        unless_empty(F.col("max_phrase_repeat")).alias("max_phrase_repeat"),
        unless_empty(F.col("max_sentence_repeat")).alias("max_sentence_repeat"),
    )
    return (
        measured.withColumn("_issues", issues)
        .withColumn(out, F.struct((F.size("_issues") == 0).alias("ok"), F.col("_issues").alias("issues"), metrics.alias("metrics")))
        .drop(
            "_clean", "_measures", "_ratio", "_issues", "token_count",
            "max_token_run", "max_phrase_repeat", "max_sentence_repeat",
        )
    )
