import importlib
import math
import random
import sys

import numpy as np
import pytest

from streamlens.llm import topk


def _rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, dims))]) for i in range(n)]


def _brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in good if c != q)
            out[q] = [(n + 1, c, -d) for n, (d, c) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("n,dims,k", [(300, 64, 20), (90, 7, 20), (15, 3, 20), (1, 4, 5)])
def test_top_k_matches_brute_force(spark, n, dims, k):
    rows = [*_rows(n, dims, n), (1000, None), (1020, [1.0, None, 2.0]), (1040, [float("nan")] * dims), (1060, [float("inf")] * dims), (None, [1.0] * dims), (1080, [0.5]), (1081, []), (1082, [0.25] * dims), (1083, [0.25] * dims)]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in topk.top_k(v, v.where("id % 20 = 0"), k, block=32, group=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = _brute(rows, k)
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_top_k_of_an_empty_table(spark):
    v = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-(1 << 28), 1 << 28, (5, 3)), rng.integers(-(1 << 28), 1 << 28, (5, 50))
    i, j, s = topk.search_block(np.arange(3) + 100, q, np.arange(50), c, 4)
    exact = q.astype(object).T @ c.astype(object)
    for row in range(3):
        assert s[i == row].tolist() == sorted(exact[row], reverse=True)[:4]
    with pytest.raises(OverflowError):
        topk.search_block(np.arange(1), np.full((5, 1), 1 << 32), np.arange(3), np.full((5, 3), 1 << 32), 1)


def _documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "th", "er", "ing", "on", "st"]) for _ in range(3))
    rows, labels = [], []
    for i in range(260):
        good = rng.random() < 0.8
        text = "\n".join(" ".join(word() for _ in range(rng.randint(5, 30))) + "." for _ in range(rng.randint(1, 4)))
        if not good:
            text += "\n" + " | ".join(word() for _ in range(80))
        elif rows and rng.random() < 0.2:
            text = rng.choice(rows)[1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(" | " not in text), 0))
    return rows + [(900, None, None, None, None), (901, "", "en", "s1", 0)], labels


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows, labels = _documents(4)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    assert not [r for r in kept["quality"] if r.text and " | " in r.text]
    good = {i for i, t, *_ in rows if t and " | " not in t}
    assert good <= {r.doc_id for r in kept["quality"]}
    seen = set()
    for r in sorted(kept["lines"], key=lambda r: r.doc_id):
        own = [x for x in (r.text or "").split("\n") if x.strip()]
        assert not seen & set(own) and r.n_chars == (None if r.text is None else len(r.text))
        seen |= set(own)
    ids = [r.doc_id for r in kept["near_duplicates"]]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in kept["lines"]}
    times = {i: [r.doc_id for r in kept["mix"]].count(i) for i in ids}
    assert max(times.values()) <= 2
    assert {r.doc_id for r in kept["packing"]} == {i for i, n in times.items() if n}
    assert cp.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_stages_with_clashing_columns_and_without_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows, labels = _documents(5)
    names = ["quality_score", "__doc", "__gone", "__kept", "kept", "gone", "mix_order", "mix_shard", "mix_size", "__key", "score", "c0"]
    wide = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    few = [(*r, *range(len(names))) for r in rows[:60] + rows[-2:]]
    few += [(800, "one very long line " * 20_000, "en", "s1", None, *range(len(names)))] + few[:3] + [(None, "no id", "en", None, 5, *range(len(names)))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (spark.createDataFrame(few, wide), spark.createDataFrame([], wide)):
        columns, n = docs.columns, docs.count()
        for k, (_, stage) in enumerate(cp.STAGES):
            out = str(tmp_path / f"clash{n}-{k}")
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            if k < 4:
                assert docs.columns == columns and all([r[x] for x in names] == list(range(len(names))) for r in docs.collect())
        assert (docs.count() > 0) == (n > 0)


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from streamlens.llm import store

    unset = N(get=lambda *_: None, set=lambda *_: None)
    there = lambda master: N(conf=unset, sparkContext=N(master=master, getConf=lambda: unset))
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(there(master))
    assert store.shared_dir(there("local[4]")).startswith("file://")


def test_entry_survives_removal(monkeypatch):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    assert not {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} and set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.import_module("streamlens.registry") and "pyspark" in sys.modules
