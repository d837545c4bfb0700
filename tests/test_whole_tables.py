"""Queries over tables longer than the test tables: no row may be left out."""

import datetime as dt

from streamlens import registry
from streamlens.sources import readers


def test_hourly_tracks_cover_all_days(spark, tmp_path):
    at = [dt.datetime(2023, 12, 30, 5, 59), dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 31, 0), dt.datetime(2024, 2, 15, 23, 30), dt.datetime(2024, 2, 15, 23, 59)]
    rows = [(i, t, i % 2, "click", 1.0 + i, "{}") for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    hour = lambda t: (t - dt.datetime(2024, 1, 1)) // dt.timedelta(hours=1)
    assert sorted((r.user_id, r.t, r.weight) for r in run("dense_track") if r.n) == sorted((i % 2, hour(t), 1.0 + i) for i, t in enumerate(at))
    days = [(u, d) for u in (0, 1) for d in range(-2, 46)]
    assert sorted((r.user_id, r.t) for r in run("robust_scores")) == days
    assert sorted((r.user_id, r.peak_time, r.auc) for r in run("burst_arcs")) == [(0, -2, 1.0), (0, 30, 3.0), (0, 45, 5.0), (1, 1, 2.0), (1, 45, 4.0)]
    assert sorted((r.user_id, r.t, r.held) for r in run("high_water")) == [(0, -43, 1.0), (0, 720, 3.0), (0, 1103, 5.0), (1, 24, 2.0), (1, 1103, 4.0)]


def test_phrase_hits_search_every_phrase(spark, tmp_path):
    word = lambda i: f"{i:04d} " + "".join(chr(97 + i * k % 26) for k in range(3, 15))
    phrases = [f"the phrase {word(i)}. rest" for i in range(1200)] + ["the phrase " + word(7) + ". again", "too short. x", None, "x" * 30, "grüße aus über 20 zeichen. y"]
    texts = [f"<{word(i)}the phrase {word(i)}{word(i + 1)}" for i in range(1200)] + [None, "", "short", "x" * 29, "y" + "x" * 40, "(Grüße) grüße aus über 20 zeichen", "the phrase " + word(3) + " the phrase " + word(1100)]
    spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    begins = [p.split(".")[0] for p in phrases if p and len(p.split(".")[0]) >= 20]
    expected = [(i, n) for i, t in enumerate(texts) if (n := sum(p in (t or "") for p in begins))]
    got = registry.queries()["phrase_hits"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.hits) for r in got) == expected and len(expected) == 1203


def test_chat_regions_take_every_region(spark):
    chat = spark.createDataFrame([(t, "a") for t in (5.0, 59.999, 60.0, 600060.0, 719940.5, 719941.0)], "timestamp double, text string")
    regions = spark.createDataFrame([(60.0 * i, 60.0 * i + 1.0) for i in range(12000)] + [(0.0, 59.9995), (4.0, 6.0)], "start double, end double")
    got = readers.chat_regions(chat, regions)
    assert got.columns == ["timestamp", "text"]
    assert sorted(r.timestamp for r in got.collect()) == [5.0, 59.999, 60.0, 600060.0, 719940.5]
