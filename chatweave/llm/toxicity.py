"""Toxicity (operator 7): non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train a linear classifier on the presence of words.
The risk on negatives is estimated as the risk on unlabelled rows less the class prior times that on
positives; where this estimate is below zero, the step goes against it (non-negative correction).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import fold, frugal, release, ship_package, store, word_hashes
from chatweave.llm.fitting import Adam, one_label, sampled_ids, sigmoid

#: Documented bounds of the training sample, and words in the model.
MOST_TOXIC = 10_000
MOST_UNLABELLED = 20_000
WORDS = 512
STEPS = 400
DECAY = 3e-6
THRESHOLD = 0.7

_MARKS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Distinct hashes of the words of each text: lower case, ASCII signs part words."""
    for _, blocks in word_hashes((t or "").lower().encode().translate(_MARKS) for t in texts):
        for words in blocks:
            yield np.unique(words)


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, present: np.ndarray) -> float:
        """Probability of toxic for the distinct word hashes of a text."""
        if not len(self.words):
            return float(sigmoid(np.array(self.bias)))
        at = np.searchsorted(self.words, present)
        at[at == len(self.words)] = 0
        return float(sigmoid(self.bias + self.weights[at[self.words[at] == present]].sum()))


def non_negative_fit(
    toxic: np.ndarray, unlabelled: np.ndarray, prior: float, toxic_n: np.ndarray | None = None, unlabelled_n: np.ndarray | None = None, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """(weights, bias) from 0/1 rows of confirmed toxic and of unlabelled documents, and how often each row occurs.

    The loss is the sigmoid loss: it is bounded, so a prior that is a little too high for the
    unlabelled rows cannot drive the risk on negatives below zero early on.
    """
    a, b = (
        (np.ones(len(m)) if n is None else n) / (len(m) if n is None else n.sum()) for m, n in ((toxic, toxic_n), (unlabelled, unlabelled_n))
    )
    adam = Adam({"w": np.zeros(toxic.shape[1], np.float32), "b": np.array(np.log(prior / (1 - prior)))}, 0.05)
    for _ in range(steps):
        w, bias = adam.params["w"], adam.params["b"]
        p_toxic, p_unlabelled = sigmoid(toxic @ w + bias), sigmoid(unlabelled @ w + bias)
        # A row's loss is 1 - p as a positive and p as a negative, so the slopes differ in sign only.
        slope_toxic, slope_unlabelled = a * p_toxic * (1 - p_toxic), b * p_unlabelled * (1 - p_unlabelled)
        wrong = toxic.T @ slope_toxic.astype(np.float32), slope_toxic.sum()
        negative = unlabelled.T @ slope_unlabelled.astype(np.float32), slope_unlabelled.sum()
        if b @ p_unlabelled - prior * (a @ p_toxic) >= 0:
            grads = [n - 2 * prior * c for c, n in zip(wrong, negative, strict=True)]
        else:
            grads = [prior * c - n for c, n in zip(wrong, negative, strict=True)]
        adam.step({"w": (grads[0] + DECAY * w).astype(np.float32), "b": np.array(grads[1])})
    return adam.params["w"].astype(float), float(adam.params["b"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1) -> Model:
    """A model from training rows of ``docs`` (doc_id, text): at most ``MOST_TOXIC`` confirmed and
    ``MOST_UNLABELLED`` unlabelled ones, chosen by a hash of the id. The prior is the share of toxic
    among all labelled training rows.

    Where every training row has a label, all that are not confirmed toxic stand for unlabelled ones.
    Without a confirmed row, or any other, the model knows no words and scores the prior.
    """
    ship_package(docs.sparkSession)
    known = one_label(labels, label).where(fold(F.col("doc_id"), folds) != held_out)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = min(max((toxic + 0.5) / (n + 1), 0.001), 0.5)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").where(fold(F.col("doc_id"), folds) != held_out)
    unlabelled = sampled_ids(ids.join(known, "doc_id", "left_anti"), MOST_UNLABELLED)
    if unlabelled.isEmpty():
        unlabelled = sampled_ids(ids.join(known.where("label = 1"), "doc_id", "left_anti"), MOST_UNLABELLED)
    chosen = sampled_ids(known.where("label = 1").select("doc_id"), MOST_TOXIC).withColumn("toxic", F.lit(1)).unionByName(
        unlabelled.withColumn("toxic", F.lit(0))
    )

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "words": [w.view(np.int64) for w in words_of(batch["text"])]})

    rows = store(
        docs.join(F.broadcast(chosen), "doc_id")  # at most MOST_TOXIC + MOST_UNLABELLED ids
        .select("toxic", "text")
        .mapInPandas(frugal(distinct_words), "toxic int, words array<long>")
    )
    n_toxic, n_rows = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_toxic or n_toxic == n_rows:
        release(rows)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    share = F.col("a") / F.lit(n_toxic), F.col("b") / F.lit(n_rows - n_toxic)
    both = (F.col("a") + F.col("b")) / F.lit(n_rows)
    spread = F.sqrt(both * (1 - both) * F.lit(1 / n_toxic + 1 / (n_rows - n_toxic)) + F.lit(1e-9))
    best = (
        rows.select("toxic", F.explode("words").alias("word"))
        .groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where("a >= 3")
        .select("word", ((share[0] - share[1]) / spread).alias("z"))
        .where("z > 4")
        .orderBy(F.desc("z"), "word").limit(WORDS)
        .collect()
    )
    words = np.sort(np.array([r.word for r in best], np.int64).view(np.uint64))
    listed = F.array([F.lit(int(w)) for w in words.view(np.int64)]) if len(words) else F.array().cast("array<long>")
    # Rows with the same words of the model count together: most have none.
    alike = rows.select("toxic", F.array_sort(F.array_intersect("words", listed)).alias("words")).groupBy("toxic", "words")
    found = alike.agg(F.count("*").alias("n")).orderBy("toxic", "words").toPandas()
    release(rows)
    matrix = np.zeros((len(found), len(words)), np.float32)
    for i, some in enumerate(found["words"]):
        matrix[i, np.searchsorted(words, np.asarray(some, np.int64).view(np.uint64))] = 1
    yes, n = found["toxic"].to_numpy() == 1, found["n"].to_numpy(float)
    weights, bias = non_negative_fit(matrix[yes], matrix[~yes], prior, n[yes], n[~yes])
    return Model(words, weights, bias)


def score_column(text: Column, model: Model) -> Column:
    """The score of whole texts; null text is empty."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(w) for w in words_of(texts)], dtype=float)

    return scored(text)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, any more columns) that score below the threshold; nothing is shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.where(score_column(F.col("text"), train(texts, labels)) < THRESHOLD)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    scored = docs.select("doc_id", score_column(F.col("text"), train(docs, labels)).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
