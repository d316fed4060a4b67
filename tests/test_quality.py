from __future__ import annotations

import random
import re
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from chatweave.operators.quality import assess_quality, max_repeat, ngrams, normalize_text, sentences, tokens

#: Arrows, as noise that is neither a letter nor usual punctuation.
SYMBOLS = "".join(map(chr, range(0x2190, 0x21A2)))


def assess(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.quality for r in assess_quality(df).orderBy("i").collect()]


def test_verdicts(spark):
    loop, normal, bad_tail, symbols, empty, blank, punct, letters, run = assess(
        spark,
        [
            "mud, rain, wind and " * 60,
            "This is an ordinary sentence. Here is another one with other words.",
            "A sentence that starts well " + "\ufffd" * 20,
            "A sentence that starts well " + SYMBOLS * 4,
            None,
            " \t\u200b\r\n",
            "well " + "!" * 12,
            "well " + "é" * 12 + "_" * 18,
            "la " * 12 + "end",
        ],
    )
    assert not loop.ok and {"low_unique_token_ratio", "repeated_phrase_loop"} <= set(loop.issues)
    assert normal.ok and normal.issues == [] and normal.metrics.unique_token_ratio == 0.9167
    assert bad_tail.issues[0] == "trailing_replacement_char"
    assert "trailing_symbol_noise" in symbols.issues
    for q in (empty, blank):
        assert (q.ok, q.issues) == (False, ["empty_transcript"])
        assert (q.metrics.char_count, q.metrics.token_count, q.metrics.max_token_run) == (0, 0, None)
    assert punct.issues == ["trailing_punctuation_loop"]
    assert letters.ok
    assert run.issues == ["repeated_token_loop"] and run.metrics.max_token_run == 12


def test_no_words(spark):
    (q,) = assess(spark, ["… — …"])
    assert (q.metrics.token_count, q.metrics.unique_token_ratio, q.metrics.max_phrase_repeat) == (0, 0.0, 0)


def test_tail_is_the_last_240_characters(spark):
    inside, outside = assess(spark, ["x \ufffd" + "a" * 239, "x \ufffd" + "a" * 240])
    assert inside.issues == ["trailing_replacement_char"] and outside.ok


def test_normalize(spark):
    noisy = ["one\x02\u200b  two\x1f \n \ufeff three", "a\r\n b \t c", "\u00a0x\x85", "a\x7fb", None]
    df = spark.createDataFrame(list(enumerate(noisy)), "i int, t string")
    got = [r.n for r in df.select("i", normalize_text(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == ["one two\nthree", "a\n\nb c", "x", "a\x7fb", ""]


def test_normalized_text_stays_as_it_is(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("a\u00e9  \t\n\r\x02\x0b\u200b\ufeff\u00a0", k=rng.randrange(30))) for _ in range(300)]
    dropped = {ord("\r"): "\n", 0xFEFF: None, 0x200B: None} | {c: None for c in range(32) if chr(c) not in "\t\n\r"}
    want = [re.sub(" *\n *", "\n", re.sub(r"[ \t]+", " ", t.translate(dropped))).strip() for t in texts]
    once = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", normalize_text(F.col("t")))
    got = once.select("i", "n", normalize_text(F.col("n")).alias("again")).orderBy("i").collect()
    assert [r.n for r in got] == want and [r.again for r in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_measures_match_plain_counting(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        n = rng.choice([0, 1, 2, 3, 5, 30, 200])
        words = [rng.choice(["a", "B", "ça", "Ünd", "it's", "9"]) for _ in range(n)]
        texts.append("".join(w + rng.choice([" ", " ", ". ", "! ", "\n", ", "]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df = df.withColumn("w", tokens(F.col("t")))
    df = df.select(
        "i", "w", *[max_repeat(ngrams(F.col("w"), n)).alias(f"r{n}") for n in (3, 4, 5)],
        max_repeat(sentences(F.col("t"))).alias("s"),
    )
    word = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ']+")
    quality = assess(spark, texts)
    for row in df.collect():
        w = [x.lower() for x in word.findall(texts[row.i])]
        assert row.w == w
        grams = {n: max(Counter(zip(*[w[k:] for k in range(n)])).values(), default=0) for n in (3, 4, 5)}
        assert (row.r3, row.r4, row.r5) == (grams[3], grams[4], grams[5])
        parts = [tuple(x.lower() for x in word.findall(p)) for p in re.split(r"[.!?]+", texts[row.i])]
        assert row.s == max(Counter(p for p in parts if len(p) >= 3).values(), default=0)
        q = quality[row.i].metrics
        if w:
            assert q.max_phrase_repeat == max(grams.values())
            assert q.max_token_run == max(len(list(g)) for _, g in groupby(w))


def test_filtering_on_the_verdict_stays_cheap(spark):
    """A filter makes Catalyst repeat definitions; the measures must not become quadratic."""
    import time

    df = spark.range(4).select(F.col("id"), F.repeat(F.lit("one two three four five. "), F.lit(4000)).alias("text"))
    started = time.time()
    assert assess_quality(df).where(~F.col("quality.ok")).count() == 4
    assert time.time() - started < 60
