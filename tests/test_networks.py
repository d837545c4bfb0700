"""Small networks: gradients, training per fold and seed, and the ensemble's Column against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlens.operators import networks as nw


def data(n=80, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, 5)) * [1, 2, 3, 1, 0] + [0, 1, 0, 0, 4]
    return x, ((x[:, 0] * x[:, 1] + x[:, 2]) > 0).astype(float), draw.random(n) + 0.2


def test_gradients_are_those_of_the_loss():
    x, y, w = data(20)
    draw = np.random.default_rng(0)
    p = {"a": draw.standard_normal((3, 5)), "b": draw.standard_normal(3), "c": draw.standard_normal(3), "d": draw.standard_normal(1)}
    _, g = nw.loss_and_gradients(p, x, y, w)
    for k in p:
        for at in np.ndindex(p[k].shape):
            up, down = {n: v.copy() for n, v in p.items()}, {n: v.copy() for n, v in p.items()}
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[k][at] == pytest.approx((nw.loss_and_gradients(up, x, y, w)[0] - nw.loss_and_gradients(down, x, y, w)[0]) / 2e-6, abs=1e-6)


def test_training_learns_and_is_the_same_for_a_seed():
    x, y, w = data()
    m = nw.train(x, y, w, seed=3)
    assert m == nw.train(x, y, w, seed=3) != nw.train(x, y, w, seed=4)
    assert ((m.predict(x) > 0) == (y > 0.5)).mean() > 0.9
    with pytest.raises(ValueError):
        nw.train(x[:0], y[:0])


def test_ensemble_column_equals_numpy_and_missing_input_is_null(spark):
    x, y, w = data()
    members = [nw.train(x, y, w, seed=s, steps=40, hidden=4) for s in (1, 2)]
    rows = [(i, v.tolist()) for i, v in enumerate(x[:20])] + [(90, None), (91, [1.0]), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [1e9] * 5)]
    df = spark.createDataFrame(rows, "id long, f array<double>")
    got = {r.id: r.p for r in df.select("id", nw.keep_probability(members, F.col("f"), 1.3, -0.2).alias("p")).collect()}
    z = np.mean([np.clip(m.predict(x[:20]), -nw.LIMIT, nw.LIMIT) for m in members], axis=0)
    assert [got[i] for i in range(20)] == pytest.approx((1 / (1 + np.exp(-(1.3 * z - 0.2)))).tolist())
    assert got[90] is None and got[91] is None and got[92] is None and 0 <= got[93] <= 1
    said = df.limit(1).select(nw.rejected(F.lit(0.2), F.lit(None).cast("boolean"), 0.3).alias("a"), nw.rejected(F.lit(0.2), F.lit(True), 0.3).alias("b"), nw.rejected(F.lit(None).cast("double"), F.lit(False), 0.3).alias("c")).first()
    assert tuple(said) == ("predictable_pass", None, None)


def test_folds_leave_their_source_out(spark, monkeypatch):
    x, y, w = data(40)
    source = [f"s{i % 3}" for i in range(40)]
    rows = [(source[i], i, float(y[i]), float(w[i]), x[i].tolist()) for i in range(40)] + [("s0", 99, None, 1.0, [0.0] * 5)]
    df = spark.createDataFrame(rows, "source string, id long, y double, w double, f array<double>").repartition(3)
    models = nw.train_folds(df, "source", "id", "y", "w", "f", [1, 2], steps=30, hidden=4).cache()
    assert sorted((r.fold or "", r.seed) for r in models.collect()) == sorted((f, s) for f in ("", "s0", "s1", "s2") for s in (1, 2))
    got = {r.id: r.p for r in nw.left_out_probabilities(df.where("id < 40"), "source", "id", "f", models).collect()}
    for i in (0, 7, 20):
        rest = np.array([s != source[i] for s in source])
        z = np.mean([nw.train(x[rest], y[rest], w[rest], s, 4, 30).predict(x[i : i + 1])[0] for s in (1, 2)])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))
    monkeypatch.setattr(nw, "MAX_CELLS", 100)
    with pytest.raises(ValueError):
        nw.train_folds(df, "source", "id", "y", "w", "f", [1])


def test_folds_are_trained_where_their_rows_are(spark, monkeypatch):
    """More numbers of rows than the driver may hold, in several blocks and turns, and rows of no source: every network is that of train()."""
    x, y, w = data(300)
    x[:, 3] = np.where(np.arange(300) % 3 == 1, x[:, 3], 0.1)  # without s1 all are equal
    source = [None if i % 50 == 0 else f"s{i % 3}" for i in range(300)]
    df = spark.createDataFrame([(source[i], i, float(y[i]), float(w[i]), x[i].tolist()) for i in range(300)], "source string, id long, y double, w double, f array<double>")
    monkeypatch.setattr(nw, "MAX_CELLS", 1000)
    monkeypatch.setattr(nw, "BLOCK", 600, raising=False)
    monkeypatch.setattr(nw, "TURN", 100, raising=False)
    got = {(r["fold"], r["seed"]): r for r in nw.train_folds(df, "source", "id", "y", "w", "f", [1, 2], steps=10, hidden=4).collect()}
    assert got.keys() == {(f, s) for f in (None, "s0", "s1", "s2") for s in (1, 2)}
    for (fold, seed), r in got.items():
        use = np.array([fold is None or s != fold for s in source])
        want = nw.train(x[use], y[use], w[use], seed, 4, 10)
        assert (r["mean"], r["scale"]) == (pytest.approx(want.mean), pytest.approx(want.scale))
        assert np.array(r["inner"]) == pytest.approx(np.array(want.inner)) and (r["inner_bias"], r["outer"], r["outer_bias"]) == (pytest.approx(want.inner_bias), pytest.approx(want.outer), pytest.approx(want.outer_bias))
