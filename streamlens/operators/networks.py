"""Small tanh networks: weighted training of many at once, folds that leave a source out, and the ensemble's probability as a Column.

The labelled rows stay with the tasks, in blocks: each step of training is a job in which every task adds up the gradients of its blocks for all folds and seeds, and the driver, which holds the
models only (MAX_CELLS numbers at most), adds the tasks' sums and takes the step. The same seeds give the same models, up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions.scoring import sigmoid
from streamlens.shared import written

#: Hidden units, steps, rate and decay of training.
HIDDEN, STEPS, RATE, DECAY = 16, 500, 0.01, 0.10
#: Numbers that the driver may hold for the models of one call: their parameters, each with two moments.
MAX_CELLS = 20_000_000
#: Numbers of a partition of labelled rows, about, and parameters of the models that are trained at a time: each task sends as many numbers to the driver.
BLOCK, TURN = 1 << 18, 1 << 16


@dataclass(frozen=True)
class Network:
    """tanh units over standardised features, and the log odds as their weighted sum. inner: one list of feature weights per unit."""

    mean: list[float]
    scale: list[float]
    inner: list[list[float]]
    inner_bias: list[float]
    outer: list[float]
    outer_bias: float

    def log_odds(self, features: Column) -> Column:
        """The log odds for an array of features."""
        def total(values: Column, weights: list[float], bias: float) -> Column:
            return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)

        z = F.zip_with(F.zip_with(features, F.array(*map(F.lit, self.mean)), lambda a, b: a - b), F.array(*map(F.lit, self.scale)), lambda a, b: a / b)
        units = F.array(*[F.tanh(total(z, w, b)) for w, b in zip(self.inner, self.inner_bias, strict=True)])
        return total(units, self.outer, self.outer_bias)

    def predict(self, x: np.ndarray) -> np.ndarray:
        units = np.tanh((x - self.mean) / self.scale @ np.array(self.inner).T + self.inner_bias)
        return units @ np.array(self.outer) + self.outer_bias


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, total: float | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted cross entropy of standardised rows and its gradients. p: a (units by features), b, c (units), d (one number). With the total of all weights, the share of these rows."""
    units = np.tanh(x @ p["a"].T + p["b"])
    odds = units @ p["c"] + p["d"][0]
    w = weight / (weight.sum() if total is None else total)
    loss = float((w * (np.logaddexp(0.0, odds) - y * odds)).sum())
    error = w * (1 / (1 + np.exp(-odds)) - y)
    back = np.outer(error, p["c"]) * (1 - units**2)
    return loss, {"a": back.T @ x, "b": back.sum(0), "c": units.T @ error, "d": np.array([error.sum()])}


def _begun(n: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Starting weights, uniform within 1 / sqrt(inputs of a unit)."""
    draw = np.random.default_rng(seed)
    start = lambda inputs, *shape: draw.uniform(-1, 1, shape) / np.sqrt(max(1, inputs))
    return {"a": start(n, hidden, n), "b": start(n, hidden), "c": start(hidden, hidden), "d": start(hidden, 1)}


def _descend(p: dict[str, np.ndarray], g: dict[str, np.ndarray], first: dict[str, np.ndarray], second: dict[str, np.ndarray], t: int, rate: float, decay: float) -> None:
    """Step t (from 1) of Adam with decoupled weight decay, in place."""
    for k in p:
        first[k] = 0.9 * first[k] + 0.1 * g[k]
        second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
        p[k] = p[k] * (1 - rate * decay) - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)


def _zeros(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.zeros_like(v) for k, v in p.items()}


def _network(mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray]) -> Network:
    return Network(mean.tolist(), scale.tolist(), p["a"].tolist(), p["b"].tolist(), p["c"].tolist(), float(p["d"][0]))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 0, hidden: int = HIDDEN, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Network:
    """One network by Adam with decoupled weight decay. Starting weights are uniform within 1 / sqrt(inputs of a unit)."""
    if not len(x) or len(x) != len(y):
        raise ValueError("rows and labels must be as many, and some")
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-8, 1.0, scale)
    z, weight = (x - mean) / scale, np.ones(len(y)) if weight is None else weight
    p = _begun(x.shape[1], hidden, seed)
    first, second = _zeros(p), _zeros(p)
    for t in range(1, max(1, steps) + 1):
        _descend(p, loss_and_gradients(p, z, y, weight)[1], first, second, t, rate, decay)
    return _network(mean, scale, p)


_MODEL = "fold string, seed int, mean array<double>, scale array<double>, inner array<array<double>>, inner_bias array<double>, outer array<double>, outer_bias double"


@dataclass(frozen=True)
class _Rest:
    """What a fold trains on, from its rows: the number, weight and labels, and each feature's mean and sum of squares around it."""

    n: int
    weight: float
    labels: frozenset[float]
    mean: np.ndarray
    squares: np.ndarray

    def joined(self, o: _Rest) -> _Rest:
        n, apart = self.n + o.n, o.mean - self.mean
        if not self.n or not o.n:
            return o if o.n else self
        return _Rest(n, self.weight + o.weight, self.labels | o.labels, self.mean + apart * (o.n / n), self.squares + o.squares + apart**2 * (self.n * o.n / n))


def _rests(x: DataFrame, wide: int) -> list[tuple[str | None, _Rest]]:
    """Every source with what is left without it, and null with all rows. Sums before and after a source are joined, none is subtracted; rows of no source are in every rest."""
    feature = [F.col("f")[k] for k in range(wide)]
    got = x.groupBy("source").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.slice(F.sort_array(F.collect_set("y")), 1, 3).alias("y"), F.array(*map(F.avg, feature)).alias("mean"), F.array(*map(F.var_pop, feature)).alias("var")).collect()
    own = {r["source"]: _Rest(r["n"], r["w"], frozenset(r["y"]), np.array(r["mean"], float), np.array(r["var"], float) * r["n"]) for r in got}
    none = _Rest(0, 0.0, frozenset(), np.zeros(wide), np.zeros(wide))
    named = sorted(s for s in own if s is not None)
    before, after = [own.get(None, none)], [none]
    for s in named:
        before.append(before[-1].joined(own[s]))
    for s in named[::-1]:
        after.append(after[-1].joined(own[s]))
    return [*((s, before[i].joined(after[len(named) - 1 - i])) for i, s in enumerate(named)), (None, before[-1])]


def _blocks(x: DataFrame, n: int, wide: int, codes: dict[str, int]) -> DataFrame:
    """The rows in order of a hash of id and of id, packed: block (from partition and place), and code, y, w and f as bytes."""
    limit = max(1, 4 * BLOCK // (wide + 3))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for pdf in batches:
            code = pdf["source"].map(codes).fillna(-1).to_numpy(np.int32)
            for i in range(0, len(pdf), limit):
                one = pdf.iloc[i : i + limit]
                f = np.array(one["f"].tolist(), float)
                yield pd.DataFrame({"part": one["part"].iloc[:1].to_numpy(), "at": [at], "code": [code[i : i + limit].tobytes()], "y": [one["y"].to_numpy(float).tobytes()], "w": [one["w"].to_numpy(float).tobytes()], "f": [f.tobytes()]})
                at += 1

    dealt = x.repartition(max(1, -(-n * (wide + 3) // BLOCK)), "id").sortWithinPartitions("id", "source", "y", "w", "f").withColumn("part", F.spark_partition_id())
    return written(dealt.select("source", "y", "w", "f", "part").mapInPandas(pack, "part int, at int, code binary, y binary, w binary, f binary"), "blocks")


def _gradients(blocks: DataFrame, wide: int, models: list[tuple[int, _Rest, np.ndarray, dict[str, np.ndarray]]]) -> list[dict[str, np.ndarray]]:
    """Each model's gradients over the rows of its rest, one job for all. models: (code of the source left out, its rest, scale, parameters), those of one source together."""
    shapes = [(k, v.shape, v.size) for k, v in models[0][3].items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, sums = None, [_zeros(p) for *_, p in models]
        for pdf in batches:
            for part, at, *packed in pdf.itertuples(index=False, name=None):
                first = min(first or (part, at), (part, at))
                code, y, w, f = (np.frombuffer(b, kind) for b, kind in zip(packed, (np.int32, float, float, float), strict=True))
                f, left = f.reshape(len(y), wide), None
                for (out, rest, scale, p), total in zip(models, sums, strict=True):
                    if out != left:
                        left, use = out, code != out
                        z, own_y, own_w = (f[use] - rest.mean) / scale, y[use], w[use]
                    for k, v in loss_and_gradients(p, z, own_y, own_w, rest.weight)[1].items():
                        total[k] += v
        if first:
            yield pd.DataFrame({"part": [first[0]], "at": [first[1]], "sums": [np.concatenate([v.ravel() for s in sums for v in s.values()]).tobytes()]})

    got = sorted(blocks.mapInPandas(run, "part int, at int, sums binary").collect())
    all_, out, i = sum(np.frombuffer(r["sums"], float) for r in got), [], 0
    for _ in models:
        out.append({})
        for k, shape, size in shapes:
            out[-1][k] = all_[i : i + size].reshape(shape)
            i += size
    return out


def train_folds(rows: DataFrame, source: str, id_: str, label: str, weight: str, features: str, seeds: list[int], steps: int = STEPS, hidden: int = HIDDEN) -> DataFrame:
    """A network for every source that is left out (fold) and every seed; fold null: for all rows. Rows without label, weight or a feature are left out, those without a source are in every fold; a fold
    whose rest has one label only has no model. Takes a job for every step, over all rows; nothing but sums and models passes through the driver."""
    x = rows.select(F.col(source).cast("string").alias("source"), F.col(id_).alias("id"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), F.col(features).cast("array<double>").alias("f"))
    x = x.where(F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("f").isNotNull() & ~F.exists("f", lambda v: v.isNull() | F.isnan(v)))
    n, least, wide = x.agg(F.count("*"), F.min(F.size("f")), F.max(F.size("f"))).first()
    if least != wide:
        raise ValueError(f"features come in {least} to {wide} numbers")
    rests = _rests(x, wide) if n else []
    held = 3 * len(rests) * len(seeds) * (hidden * ((wide or 0) + 2) + 1)
    if held > MAX_CELLS:
        raise ValueError(f"{len(rests)} folds of {len(seeds)} seeds are {held} numbers, more than {MAX_CELLS}: join sources, or train fewer units")
    codes = {s: i for i, (s, _) in enumerate(rests) if s is not None}
    jobs = [(s, int(seed), rest, np.where((scale := np.sqrt(rest.squares / rest.n)) < 1e-8, 1.0, scale)) for s, rest in rests if len(rest.labels) == 2 for seed in seeds]
    blocks = _blocks(x, n, wide, codes) if jobs else None
    out, some = [], max(1, TURN // (hidden * ((wide or 0) + 2) + 1))
    for turn in (jobs[i : i + some] for i in range(0, len(jobs), some)):
        models = [(codes.get(s, -2), rest, scale, _begun(wide, hidden, seed)) for s, seed, rest, scale in turn]
        first, second = [_zeros(p) for *_, p in models], [_zeros(p) for *_, p in models]
        for t in range(1, max(1, steps) + 1):
            for (*_, p), g, a, b in zip(models, _gradients(blocks, wide, models), first, second, strict=True):
                _descend(p, g, a, b, t, RATE, DECAY)
        out += [(s, seed, *asdict(_network(rest.mean, scale, p)).values()) for (s, seed, rest, scale), (*_, p) in zip(turn, models, strict=True)]
    return rows.sparkSession.createDataFrame(out, _MODEL)


def _forward(features: Column, model: str) -> Column:
    """log_odds of a model given as a struct column."""
    m = F.col(model)
    total = lambda values, weights, bias: F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), bias, lambda s, v: s + v)
    z = F.zip_with(F.zip_with(features, m["mean"], lambda a, b: a - b), m["scale"], lambda a, b: a / b)
    units = F.zip_with(m["inner"], m["inner_bias"], lambda w, b: F.tanh(total(z, w, b)))
    return total(units, m["outer"], m["outer_bias"])


def left_out_probabilities(rows: DataFrame, source: str, id_: str, features: str, models: DataFrame) -> DataFrame:
    """id and p: each row by the models that have not seen its source, by the mean of their log odds; sources without a model are left out. models: those of train_folds."""
    names = [c.split()[0] for c in _MODEL.split(", ")][2:]
    m = models.where("fold IS NOT NULL").select(F.col("fold").alias("__fold"), F.struct(*names).alias("__m"))
    x = rows.select(F.col(source).cast("string").alias("__fold"), F.col(id_).alias("id"), F.col(features).cast("array<double>").alias("__f")).join(m, "__fold")
    odds = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), _forward(F.col("__f"), "__m")))
    return x.select("id", odds.alias("z")).groupBy("id").agg(sigmoid(F.avg("z")).alias("p"))


#: The log odds of a probability 1e-9 from certain; members and their mean are held to it.
LIMIT = float(np.log((1 - 1e-9) / 1e-9))


def keep_probability(networks: list[Network], features: Column, scale: float, intercept: float) -> Column:
    """The chance that a card is kept: the mean of the members' log odds, calibrated by scale and intercept. Null when features are missing, too few or too many, or any of them is null."""
    hold = lambda z: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), z))
    wide = len(networks[0].mean)
    mean = hold(sum((hold(n.log_odds(features)) for n in networks[1:]), hold(networks[0].log_odds(features))) / len(networks))
    whole = features.isNotNull() & (F.size(features) == wide) & ~F.exists(features, lambda v: v.isNull())
    return F.when(whole, 1 / (1 + F.exp(-(scale * mean + intercept))))


def rejected(probability: Column, protected: Column, threshold: float) -> Column:
    """Why a second-look card is held back: predictable_pass for one that its creator or viewers did not ask for, with a known chance under the threshold; else null."""
    return F.when(~F.coalesce(protected, F.lit(False)) & (probability < threshold), "predictable_pass")
