"""Rankers: weighted logistic and pairwise training, scoring as Columns, grouped cross-validation.

Pairs and features are made by Spark; the models are small (tens of weights), so gradient
descent runs on sufficient arrays: in the driver for one model on a bounded training set, in groups for one
model per held-out source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions.scoring import linear, sigmoid

#: Rows that one training set may bring to one place.
MAX_ROWS = 1_000_000


@dataclass
class Linear:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def score(self, features: Column) -> Column:
        """Raw score as a Column over an array of features."""
        return linear(features, self.mean, self.scale, self.weights, self.bias)

    def probability(self, features: Column) -> Column:
        return sigmoid(self.score(features))


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, anchor: np.ndarray | None, epochs: int, rate: float, with_bias: bool) -> tuple[np.ndarray, float]:
    w, b = (np.zeros(x.shape[1]) if anchor is None else anchor.copy()), 0.0
    base = np.zeros(x.shape[1]) if anchor is None else anchor
    total = max(weight.sum(), 1e-12)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) * weight / total
        w -= rate * (x.T @ e + l2 * (w - base))
        b -= rate * e.sum() * with_bias
    return w, float(b)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 0.01, anchor: list[float] | None = None, epochs: int = 800, rate: float = 0.5) -> Linear:
    """Weighted logistic regression with a quadratic pull towards an anchor (or zero)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w, b = _descend((x - mean) / scale, y, np.ones(len(y)) if weight is None else weight, l2, None if anchor is None else np.array(anchor), epochs, rate, True)
    return Linear(mean.tolist(), scale.tolist(), w.tolist(), b)


def preference_pairs(rows: DataFrame, group: str, id_: str, label: str, weight: str, features: str) -> DataFrame:
    """Differences of features for every pair of unequal labels in a group, the better first: diff and weight sqrt(w1 w2) |y1 - y2|."""
    cols = [group, id_, label, weight, features]
    a, b = rows.select(*cols).toDF(group, "ia", "ya", "wa", "fa"), rows.select(*cols).toDF(group, "ib", "yb", "wb", "fb")
    p = a.join(b, group).where("ya > yb")
    return p.select(group, F.zip_with("fa", "fb", lambda u, v: u - v).alias("diff"), (F.sqrt(F.col("wa") * F.col("wb")) * (F.col("ya") - F.col("yb"))).alias("weight"))


def fit_pairwise(pairs: DataFrame, l2: float = 0.01, anchor: list[float] | None = None, epochs: int = 400, rate: float = 0.5) -> Linear:
    """A linear ranker from preference pairs (logistic loss on differences, no bias)."""
    if pairs.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} pairs: train on a sample of groups")
    pdf = pairs.select("diff", "weight").toPandas()
    x = np.array(pdf["diff"].tolist(), float)
    scale = np.maximum(x.std(0), 1e-6)
    w, _ = _descend(x / scale, np.ones(len(x)), pdf["weight"].to_numpy(), l2, None if anchor is None else np.array(anchor), epochs, rate, False)
    return Linear([0.0] * x.shape[1], scale.tolist(), w.tolist(), 0.0)


def leave_one_out(rows: DataFrame, group: str, id_: str, label: str, features: str, folds: int = 10) -> DataFrame:
    """id and p: every row scored by a model that has not seen its source's fold. Sources are dealt to folds by hash.

    Each fold's task reads all rows of the other folds: for training sets of up to MAX_ROWS rows.
    """
    if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError("the training set is too large for one task")
    x = rows.select(F.col(id_).alias("id"), F.col(label).cast("double").alias("y"), F.col(features).alias("f"), F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("own"))
    dealt = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        fold = int(pdf["fold"].iloc[0])
        f, mine = np.array(pdf["f"].tolist(), float), (pdf["own"] == fold).to_numpy()
        if not mine.any() or mine.all() or pdf["y"][~mine].nunique() < 2:
            return pd.DataFrame({"id": pdf["id"][mine], "p": np.full(mine.sum(), 0.5)})
        m = fit_logistic(f[~mine], pdf["y"].to_numpy()[~mine], epochs=200)
        z = (f[mine] - np.array(m.mean)) / np.array(m.scale) @ np.array(m.weights) + m.bias
        return pd.DataFrame({"id": pdf["id"][mine], "p": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return dealt.groupBy("fold").applyInPandas(run, "id long, p double")


def ensemble(probabilities: list[Column]) -> Column:
    """Mean of the log odds, back as a probability."""
    from streamlens.functions.scoring import logit

    return sigmoid(sum((logit(p) for p in probabilities[1:]), logit(probabilities[0])) / len(probabilities))


def weak_label(similarity: Column, speech: Column, high: float, low: float) -> Column:
    """1 for speech above high, 0 below low, -1 between; without speech 0."""
    return F.when(~F.coalesce(speech, F.lit(False)), 0).when(similarity >= high, 1).when(similarity < low, 0).otherwise(-1)
