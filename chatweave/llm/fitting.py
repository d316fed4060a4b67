"""Bounded samples of training rows and a small optimizer for models fitted with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled_ids(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, ...), chosen by a hash of the id: alike at every size and in any order."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label 0/1): repeated rows of an id count once, with the larger label; null labels and ids do not count."""
    label = F.col(f"`{name}`").cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] = self.params[k] - self.rate * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
