import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlens.llm import mixing, packing, sequences

DOCS = "doc_id long, text string, source string, size int"
ROWS = [(1, "one two three", "a", 9), (2, None, "a", 9), (3, "", None, 9), (4, "x " * 3000, "b", 9), (None, "left over words", "b", 9), (1, "one two three", "a", 9)]


def test_pack_fills_every_sequence():
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 900, 300), [5000, 2048, 4096, 1]])
    pieces, room, cost = packing.pack(sizes)
    doc, start, n, seq, offset = pieces.T
    assert (np.bincount(doc, weights=n) == sizes).all() and (np.bincount(seq, weights=n) == room).all()
    assert all(r == packing.LENGTH or r & (r - 1) == 0 for r in room) and room.sum() == sizes.sum()
    for s in np.unique(seq):
        o = np.argsort(offset[seq == s])
        assert (offset[seq == s][o] == np.cumsum(n[seq == s][o]) - n[seq == s][o]).all()
    for d in np.unique(doc):
        o = np.argsort(start[doc == d])
        assert (start[doc == d][o] == np.cumsum(n[doc == d][o]) - n[doc == d][o]).all()
    mixed = cost[(room == packing.LENGTH) & (np.bincount(seq, weights=n == packing.LENGTH) == 0)]
    assert mixed.std() < 0.35 * mixed.mean()


def test_pack_empty_and_single():
    assert packing.pack(np.zeros(0, int))[0].shape == (0, 5)
    assert packing.pack(np.array([1]))[0].tolist() == [[0, 0, 1, 0, 0]]


def test_pack_documents_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack_documents(spark.createDataFrame(ROWS, DOCS).withColumn("offset", F.lit("clash"))).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, text, _, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        rows = [r for r in by[i, len(ids)]]
        covered = sorted((r.start, r.length, r.ids_crc32) for r in rows)
        assert {a for a, _, _ in covered} >= {0}
        for a, n, crc in covered:
            assert crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _, _ in ROWS)


def test_pack_documents_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(total):
    slots = sequences.feistel(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert (slots != np.arange(total)).mean() > 0.9 and (slots != sequences.feistel(np.arange(total), total, key=1)).any()


def test_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 40)) for i in range(200)] + [(500, None), (None, "x y")], "doc_id long, text string").repartition(3)
    got = sequences.materialise_order(docs, str(tmp_path / "out"), length=64, per_shard=8).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(r.slot == r.shard * 8 + r.record for r in got)
    back = {(r.shard, r.record): bytes(r.value) for r in sequences.read_slots(spark, str(tmp_path / "out"), 64).collect()}
    assert len(back) == len(got)
    for r in got:
        ids = np.frombuffer(back[r.shard, r.record], "<u2")
        assert zlib.crc32(ids[: r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 and (ids[r.n_tokens :] == 0).all()
    assert {d for r in got for d in r.doc_ids} == {*range(200), 500, None}


def test_shards_keep_slot_order_when_the_writer_spills(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 40)) for i in range(3000)], "doc_id long, text string").repartition(3)
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        conf.set(name, "50")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = sequences.materialise_order(docs, str(tmp_path / "out"), length=64, per_shard=100).collect()
    finally:
        conf.remove(name)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    back = {(r.shard, r.record): bytes(r.value) for r in sequences.read_slots(spark, str(tmp_path / "out"), 64).collect()}
    assert len(got) == len(back) > 500
    assert all(zlib.crc32(np.frombuffer(back[r.shard, r.record], "<u2")[: r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 for r in got)


def test_sequence_ids_are_those_of_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    rows = [(i, x, "k", 1) for i, x in enumerate(["İ! İ- İ_ x İ|", "A b. C'd é—f", "", None, "İ" * 5000, "long " * 30_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, ids int").coalesce(1)
    got = sequences.materialise_order(df, str(tmp_path / "out"), length=128, per_shard=64).collect()
    back = {(r.shard, r.record): np.frombuffer(bytes(r.value), "<u2") for r in sequences.read_slots(spark, str(tmp_path / "out"), 128).collect()}
    flat = np.concatenate([back[r.shard, r.record][: r.n_tokens] for r in sorted(got, key=lambda r: r.ordinal)])
    assert flat.tolist() == [x for _, text, _, _ in rows for x in t.encode(text or "", add_special_tokens=False).ids + [1]]


def test_shards_of_an_empty_table(spark, tmp_path):
    assert sequences.materialise_order(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none")).count() == 0


def _brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(names, [(5, 2, 1)[i % 3] for i in range(len(names))], strict=True))
    t, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            t.update({s: left * w[s] / total for s in open_})
            break
        for s in over:
            t[s] = cap * sizes[s]
        left, open_ = left - sum(t[s] for s in over), open_ - over
    return t


def test_mix_targets_and_taken_words(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["s0", "s1", "s2", "é", None, "z"][int(rng.integers(0, 6)) if i % 3 else 0], 1) for i in range(600)]
    docs = spark.createDataFrame(rows + [(700, None, "void", 1), (701, "", "void", 1), (None, "a b", "s1", 1)], DOCS)
    got = mixing.mix(docs).select(*docs.columns, "mix_size", "mix_target", "mix_source_size", F.size("mix_shards").alias("times")).collect()
    assert len(got) == 603
    sizes = {}
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and 0 <= r.times <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
    want = _brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.mix_target - want[s]) < 1e-6 * max(1, want[s]) and r.mix_source_size == sizes[s] for r in mine)
        assert abs(sum(r.mix_size * r.times for r in mine) - want[s]) <= 60


def test_mix_is_repeatable_and_handles_an_empty_table(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), f"s{i % 4}", 0) for i in range(200)] * 2, DOCS)
    one, two = ({(r.doc_id, r.text): r.mix_shards for r in mixing.mix(docs.repartition(n)).collect()} for n in (2, 5))
    assert one == two
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_documents_of_a_capped_source_come_twice_at_most(spark):
    rows = [(i, "" if i < 40 else "w " * 5, None if i % 2 else "a", 0) for i in range(60)] + [(1000 + i, "w " * 50, "b", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).select("source", "mix_size", "mix_source_size", "mix_target", F.size("mix_shards").alias("n")).collect()
    assert {r.source for r in got if r.mix_target == 2 * r.mix_source_size} >= {"a"} and max(r.n for r in got) <= 2


def test_mixed_rows_are_in_shard_order_and_carry_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 7), f"s{i % 4}", 0, i, "k", 1) for i in range(300)], DOCS + ", mix_shard int, mix_order string, key int")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_shards", "mix_order_"]
    place = {(r.doc_id, s): (s, r.mix_order_) for r in mixed.collect() for s in r.mix_shards}
    rows = mixing.mixed_rows(docs, 5)
    assert rows.columns == docs.columns
    got = rows.collect()
    assert len(got) == sum(len(r.mix_shards) for r in mixed.collect()) and all(r.mix_shard == r.doc_id and r.mix_order == "k" for r in got)
    left, at = sorted(place.values()), 0
    for r in got:  # each row stands where its shard and order put it
        assert (r.doc_id, left[at][0]) in place and place[r.doc_id, left[at][0]][1] == left[at][1]
        at += 1


def test_splitting_tree_keeps_quotas(spark):
    q = spark.createDataFrame([([100, 0, 37, 512],)], "quotas array<long>")
    leaves = mixing.split_quotas(q, 8).collect()
    assert [sum(x) for x in zip(*(r.quotas for r in leaves), strict=True)] == [100, 0, 37, 512]
    assert all(min(r.quotas) >= 0 for r in leaves) and max(sum(r.quotas) for r in leaves) - min(sum(r.quotas) for r in leaves) <= 3
    draws = [mixing.split_quotas(spark.createDataFrame([([50, 50],)], "quotas array<long>"), 2, f"s{i}").where("shard = 0").first().quotas[0] for i in range(25)]
    assert 20 < np.mean(draws) < 30 and np.std(draws) > 0.5


def test_taken_rows_come_once_for_each_shard(spark):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 7), f"s{i % 4}", 0) for i in range(100)], DOCS)
    mixed = mixing.mix(docs)
    rows = mixing.take(mixed, docs.columns)
    assert rows.count() == mixed.agg(F.sum(F.size("mix_shards"))).first()[0]
