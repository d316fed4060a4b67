"""Quality classifier (operator 10): attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded; gated attention, learned
from document labels alone, weighs the passages; the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import fold, ship_package, word_hashes
from chatweave.llm.fitting import Adam, one_label, sampled_ids, sigmoid

#: Documented bound of the training sample.
MOST_ROWS = 20_000
PASSAGE_WORDS = 64
HIDDEN = 16
GATE = 8
STEPS = 1500
BATCH = 256
THRESHOLD = 0.3

#: Byte classes: the share of each among the bytes of a passage is a feature.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,", b"!?", b"#$%&*", b"|<>{}[]", b"@:/", b";\"'()-", b"\n", bytes(range(128, 256))]
_CLASS_OF = np.full(256, len(_CLASSES))
for _i, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes)] = _i
N_FEATURES = len(_CLASSES) + 1 + 6


def passages(text: str) -> np.ndarray:
    """Features of each passage (rows); the empty text is one passage of zeros.

    Shares of byte classes, mean word length, distinct words, words seen before in the document,
    lines and words that repeat the one before, and the passage's length.
    """
    data = text.encode()
    (_, (hashes,)), = list(word_hashes([data]))
    if not len(hashes):
        return np.zeros((1, N_FEATURES))
    n = -(-len(hashes) // PASSAGE_WORDS)
    raw = np.frombuffer(data, np.uint8)
    space = np.isin(raw, (9, 10, 11, 12, 13, 32))
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    cuts = begins[::PASSAGE_WORDS]
    of_byte = np.searchsorted(cuts, np.arange(len(raw)), side="right") - 1
    of_byte[of_byte < 0] = 0
    counts = np.bincount(of_byte * (len(_CLASSES) + 1) + _CLASS_OF[raw], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    size = counts.sum(1, keepdims=True)
    of_word = np.arange(len(hashes)) // PASSAGE_WORDS
    in_passage = np.bincount(of_word, minlength=n)
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes), bool)
    same = hashes[order][1:] == hashes[order][:-1]
    again[order[1:][same]] = True
    here = np.zeros(len(hashes), bool)
    here[order[1:][same & (of_word[order][1:] == of_word[order][:-1])]] = True
    next_to = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) > 1 else hashes[:0]
    order = np.argsort(pairs, kind="stable")
    pair_again = np.zeros(len(hashes), bool)
    pair_again[order[1:][pairs[order][1:] == pairs[order][:-1]]] = True
    share = [np.bincount(of_word, x, minlength=n) / in_passage for x in (again, here, next_to, pair_again)]
    return np.column_stack([counts / size, size[:, 0] / in_passage / 10, *share, np.log1p(in_passage) / 5])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def score(self, bag: np.ndarray) -> float:
        return float(forward(self.params, (bag - self.mean) / self.scale, np.zeros(1, int))["p"][0])


def start_params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def made(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    return {
        "W": made(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": made(HIDDEN, GATE), "U": made(HIDDEN, GATE),
        "a": made(GATE), "c": made(HIDDEN), "d": np.zeros(()),
    }


def forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Bags laid end to end in ``x``, beginning at ``starts``: h encodes, t and g gate, w weighs, z is the bag."""
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    w = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(w[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "w": w, "z": z, "sizes": sizes, "p": sigmoid(z @ p["c"] + p["d"])}


def backward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, x, starts)
    slope = (f["p"] - y) / len(y)
    dz = np.repeat(slope[:, None] * p["c"], f["sizes"], axis=0)
    dw = (dz * f["h"]).sum(1)
    de = f["w"] * (dw - np.repeat(np.add.reduceat(f["w"] * dw, starts), f["sizes"]))
    dtg = de[:, None] * p["a"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["w"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de,
        "c": f["z"].T @ slope, "d": slope.sum(),
    }


def fit(bags: list[np.ndarray], y: np.ndarray, steps: int = STEPS) -> Model:
    rng = np.random.default_rng(7)
    rows = np.concatenate(bags)
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    adam = Adam(start_params(rng), 0.01)
    for k in range(steps):
        adam.rate = 0.01 * (1 - k / steps)
        pick = rng.integers(0, len(bags), min(BATCH, len(bags)))
        some = [bags[i] for i in pick]
        starts = np.cumsum([0, *[len(b) for b in some[:-1]]])
        grads = backward(adam.params, np.concatenate(some), starts, y[pick])
        adam.step({k: g + 1e-4 * adam.params[k] for k, g in grads.items()})
    return Model(mean, scale, adam.params)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0) -> Model | None:
    """A model from at most ``MOST_ROWS`` labelled training rows of ``docs`` (doc_id, text), chosen by a
    hash of the id; None if there is no such row."""
    ship_package(docs.sparkSession)
    chosen = sampled_ids(one_label(labels, label).where(fold(F.col("doc_id"), folds) != held_out), MOST_ROWS)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [passages(t or "").astype(np.float32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "bag": bags})

    rows = (
        docs.join(F.broadcast(chosen), "doc_id")  # at most MOST_ROWS ids
        .select("doc_id", "label", "text")
        .mapInPandas(encode, "doc_id long, label int, bag binary")
        .toPandas()
        .sort_values(["doc_id", "bag"])
    )
    if not len(rows):
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES).astype(float) for b in rows["bag"]]
    return fit(bags, rows["label"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), whole texts.

    Null text is empty. Without any labelled training row every score is 0.5.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [0.5 if model is None else model.score(passages(t or "")) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
