"""Concepts against an exact decomposition; refreshing one source's rows by kind; maintenance that resumes without double work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlens.operators import concepts, indexing
from streamlens.streaming import maintenance


@pytest.fixture(scope="module")
def matrix():
    draw = np.random.default_rng(2)
    low = draw.standard_normal((120, 6)) @ (draw.standard_normal((6, 40)) * np.array([9, 7, 5, 4, 3, 2])[:, None])
    a = (low + 0.3 * draw.standard_normal((120, 40))) * (draw.random((120, 40)) < 0.6)
    a[7] = 0.0
    return a


def sparse(spark, a):
    rows = [(i, [(int(j), float(a[i, j])) for j in np.flatnonzero(a[i])]) for i in range(len(a))]
    return spark.createDataFrame(rows, "id long, row array<struct<feature:long,value:double>>").repartition(5)


@pytest.mark.parametrize("rank", [3, 6, 12])
def test_projection_error_is_near_the_best(spark, matrix, rank, monkeypatch):
    monkeypatch.setattr(concepts, "CELLS", 50)  # rows go in slices
    c = concepts.fit(sparse(spark, matrix), 40, rank=rank, oversample=4, seed=3)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    best = np.linalg.norm(matrix - (u[:, :rank] * s[:rank]) @ vt[:rank])
    got = np.linalg.norm(matrix - matrix @ c.components @ c.components.T)
    assert best <= got <= 1.05 * best
    assert np.allclose(c.components.T @ c.components, np.eye(rank), atol=1e-9) and np.allclose(c.singular, s[:rank], rtol=0.05)


def test_projected_vectors_have_unit_length_and_empty_rows_none(spark, matrix):
    rows = sparse(spark, matrix)
    c = concepts.fit(rows, 40, rank=5, seed=1)
    got = {r.id: (np.array(r.vector), r.kept) for r in concepts.project(rows, c).collect()}
    assert len(got) == 120 and got[7][1] == 0 and not got[7][0].any()
    for i, (v, kept) in got.items():
        y = matrix[i] @ c.components
        assert kept == pytest.approx(np.linalg.norm(y)) and (i == 7 or np.allclose(v, y / np.linalg.norm(y)))


def test_concepts_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, row array<struct<feature:long,value:double>>")
    c = concepts.fit(none, 8, rank=4)
    assert c.components.shape == (8, 4) and not c.singular.any() and concepts.project(none, c).count() == 0


def test_unknown_terms_are_dropped(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, None)], "id long, text string")
    q = spark.createDataFrame([(1, "b x a b"), (2, "x y")], "id long, text string")
    words = F.split("text", " ")
    assert [(r.id, r.terms) for r in concepts.known_terms(q, "id", words, concepts.vocabulary(d, words)).collect()] == [(1, ["b", "a", "b"])]


ENTRIES = "source string, kind string, id long, text string"


def listed(spark, path):
    return sorted(tuple(r) for r in indexing.entries(spark, path).select("source", "kind", "id", "text").collect())


def test_refresh_replaces_one_source_by_kind_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [("a", "clip", 1, "x"), ("a", "evidence", 2, "kept"), ("a", "transcript", 3, "t"), ("b", "clip", 4, "y"), ("c", "clip", 5, "z")]
    indexing.build(spark.createDataFrame(first, ENTRIES), path, shards=2)
    fresh = spark.createDataFrame([("a", "clip", 6, "new"), ("a", "evidence", 7, "no"), ("b", "clip", 8, "no")], ENTRIES)
    want = sorted([("a", "clip", 6, "new"), ("a", "evidence", 2, "kept"), *first[3:]])
    for _ in range(2):
        indexing.refresh(path, fresh, spark.createDataFrame([("a", "r1")], "source string, revision string"), ["clip", "transcript"], shards=2)
        assert listed(spark, path) == want
    assert sorted((r.source, r.kind, r.revision) for r in indexing.marks(spark, path).collect()) == [("a", "clip", "r1"), ("a", "transcript", "r1")]


def test_a_refresh_to_nothing_empties_the_partition(spark, tmp_path):
    path = str(tmp_path / "index")
    indexing.build(spark.createDataFrame([("a", "clip", 1, "x")], ENTRIES), path, shards=1)
    indexing.refresh(path, spark.createDataFrame([], ENTRIES), spark.createDataFrame([("a",)], "source string"), ["clip"], shards=1)
    assert listed(spark, path) == []


def test_a_failed_refresh_leaves_the_index_and_its_stage_can_be_applied(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [("a", "clip", 1, "x"), ("b", "clip", 2, "y")]
    indexing.build(spark.createDataFrame(first, ENTRIES), path, shards=1)
    sources = spark.createDataFrame([("a",)], "source string")
    broken = spark.createDataFrame([("a", "clip", 9, "new")], ENTRIES).withColumn("text", F.udf(lambda x: 1 / 0, "string")("text"))
    with pytest.raises(Exception, match="division"):
        indexing.refresh(path, broken, sources, ["clip"], shards=1)
    assert listed(spark, path) == first
    stage = indexing.staged(path, spark.createDataFrame([("a", "clip", 9, "new")], ENTRIES), sources, ["clip"], shards=1)
    for _ in range(2):
        indexing.applied(stage, path)
    assert listed(spark, path) == [("a", "clip", 9, "new"), ("b", "clip", 2, "y")]


def test_maintenance_resumes_without_double_work_and_retries_failures(spark, tmp_path):
    path, log, asked = str(tmp_path / "index"), str(tmp_path / "log"), []
    indexing.build(spark.createDataFrame([("a", "clip", 0, "old"), ("b", "clip", 0, "old")], ENTRIES), path, shards=2)
    schema, now, down = "source string, revision string, at double", [0.0], {"b"}

    def rebuild(sources):
        rows = sorted((r.source, r.revision) for r in sources.collect())
        asked.append(rows)
        fresh = spark.createDataFrame([(s, "clip", 1, v) for s, v in rows if s not in down], ENTRIES)
        return fresh, spark.createDataFrame([(s,) for s, _ in rows if s in down], "source string")

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
        q = maintenance.maintain(stream, path, ["clip"], rebuild, str(tmp_path / name), shards=2, retry_seconds=300.0, clock=lambda: now[0])
        q.awaitTermination()

    def tell(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)

    tell(("a", "r1", 1.0), ("a", "r2", 2.0), ("b", "r1", 1.0))
    run("cp")
    assert asked == [[("a", "r2"), ("b", "r1")]] and listed(spark, path) == [("a", "clip", 1, "r2"), ("b", "clip", 0, "old")]
    run("other")  # the log is read from its beginning, as after a crash before the checkpoint: a is done, b waits
    assert len(asked) == 1
    now[0], _ = 299.0, tell(("a", "r2", 3.0))
    run("cp")
    assert len(asked) == 1
    now[0], _ = 301.0, tell(("c", "r1", 4.0))
    down.clear()
    run("cp")
    assert asked[1:] == [[("b", "r1"), ("c", "r1")]]
    assert listed(spark, path) == [("a", "clip", 1, "r2"), ("b", "clip", 1, "r1"), ("c", "clip", 1, "r1")]
