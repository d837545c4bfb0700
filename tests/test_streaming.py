"""Live operators on streams of files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from streamlens.streaming import live

T0 = datetime(2024, 1, 1)


def _log(spark, tmp_path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return live.read_log(spark, str(tmp_path / "log"), schema, files_per_batch=1)


def test_coalesced_progress_keeps_changes_and_the_high_water_mark(spark, tmp_path):
    schema = "job_id string, id long, at double, event_type string, phase string, progress double"
    rows = [("a", 1, 0.0, "progress", "p", 0.10), ("a", 2, 0.5, "progress", "p", 0.105), ("a", 3, 0.6, "progress", "p", 0.20), ("a", 4, 0.7, "progress", "q", 0.15), ("a", 5, 0.8, "error", "q", None), ("a", 6, 5.0, "progress", "q", 0.0), ("b", 7, 0.0, "progress", "p", 0.5)]
    stream = _log(spark, tmp_path, [rows], schema)
    got = live.run_to_table(live.coalesce_progress(stream), "coalesced", checkpoint=str(tmp_path / "cp")).collect()
    assert sorted((r.id, round(r.high_water, 3)) for r in got) == [(1, 0.1), (3, 0.2), (4, 0.2), (5, 0.2), (6, 0.2), (7, 0.5)]


def test_log_is_appended_once(spark, tmp_path):
    schema = "id long, x string"
    stream = _log(spark, tmp_path, [[(1, "a")], [(2, "b")]], schema)
    for _ in range(2):  # the second run finds nothing new behind its checkpoint
        live.append_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_sessions_and_windows_on_whole_tables(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    e = spark.createDataFrame([("j", at(0)), ("j", at(11)), ("j", at(30))], "job_id string, ts timestamp")
    got = [r.n for r in live.live_sessions(e, ["job_id"], "ts").orderBy("start").collect()]
    assert got == [2, 1]
    c = spark.createDataFrame([("j", at(1), "clip it", 2), ("j", at(14), "hello", 0), ("j", at(15), "!clips", 1)], "job_id string, ts timestamp, text string, emotes int")
    got = [(r.messages, r.emotes, r.intents) for r in live.chat_windows(c, "ts").orderBy("start").collect()]
    assert got == [(2, 2, 1), (1, 1, 0)]


def test_histogram_stream(spark, tmp_path):
    stream = _log(spark, tmp_path, [[("j", 0.5), ("j", 1.5)], [("j", 0.7)]], "job_id string, t double")
    got = live.run_to_table(live.histogram(stream, ["job_id"], F.col("t"), 1.0), "bins", "complete", str(tmp_path / "cp")).collect()
    assert sorted((r.bin, r.n) for r in got) == [(0, 2), (1, 1)]


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(seconds=5)), ("b", T0)]
    stream = _log(spark, tmp_path, [rows], "id string, ts timestamp")
    got = live.run_to_table(live.deduplicated(stream, ["id"], "ts"), "once", checkpoint=str(tmp_path / "cp")).collect()
    assert sorted(r.id for r in got) == ["a", "b"]


def test_stalled_workers_and_progress(spark):
    p = spark.createDataFrame([(1, 10.0, 5.0, 50.0), (1, 40.0, 10.0, 50.0), (2, 10.0, 10.0, 50.0)], "worker int, done double, elapsed double, share double")
    r = live.progress_snapshot(p, 100.0).first()
    assert (r.coverage, r.rate, r.seconds_left) == (0.5, 5.0, 40.0)
    assert [x.worker for x in live.stalled(p, "worker", "done", F.lit(50.0), 20.0).collect()] == [2]
