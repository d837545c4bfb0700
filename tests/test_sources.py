"""Readers and writers: round trips and small files."""

import json
import wave

import numpy as np
from pyspark.sql import functions as F

from streamlens.operators import learning
from streamlens.sources import readers, writers


def test_envelope_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "job_id string, x double")
    writers_path = str(tmp_path / "e")
    readers.write_envelope(rows, writers_path, "signals", 2)
    back = readers.read_envelope(spark, writers_path, "job_id string, x double", "signals", 2)
    assert sorted((r.job_id, r.x) for r in back.collect()) == [("a", 1.5), ("b", None)]
    assert readers.read_envelope(spark, writers_path, "job_id string, x double", "signals", 3).count() == 0


def test_chat_replay_drops_messages_without_offset(spark, tmp_path):
    chat = {"comments": [{"content_offset_seconds": 3.0, "message": {"body": "hi", "emoticons": [{"_id": "1"}]}}, {"message": {"body": "x"}}, {"content_offset_seconds": 1.0, "message": {}}]}
    (tmp_path / "c.json").write_text(json.dumps(chat))
    got = readers.read_chat_replay(spark, str(tmp_path / "c.json"))
    assert sorted((r.timestamp, r.text, r.emotes) for r in got.collect()) == [(1.0, "", 0), (3.0, "hi", 1)]
    regions = spark.createDataFrame([(0.0, 2.0), (0.5, 1.5)], "start double, end double")
    assert [r.timestamp for r in readers.chat_regions(got, regions).collect()] == [1.0]


def test_chapters_are_clipped(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"job_id": "j", "duration": 100.0, "chapters": [{"start": -5.0, "end": 50.0, "game": "a"}, {"start": 90.0, "end": 200.0, "game": "b"}, {"start": 120.0, "end": 130.0, "game": "c"}]}))
    got = readers.chapters(spark, str(tmp_path / "v.json")).orderBy("start").collect()
    assert [(r.start, r.end, r.game) for r in got] == [(0.0, 50.0, "a"), (90.0, 100.0, "b")]


def test_wav_windows_find_the_pitch(spark, tmp_path):
    rate = 8000
    x = (np.sin(2 * np.pi * 200 * np.arange(2 * rate) / rate) * 16000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    got = readers.wav_windows(spark, str(tmp_path)).orderBy("t").collect()
    assert [r.t for r in got] == [0.0, 1.0] and all(abs(r.f0 - 200) < 3 and abs(r.rms - 16000 / 32768 / 2**0.5) < 0.01 for r in got)


def test_subtitles_written_are_read_back(spark, tmp_path):
    words = spark.createDataFrame([("j", 0.0, 0.4, "one"), ("j", 0.5, 0.9, "{two}"), ("j", 3.0, 3.5, "three")], "job_id string, start double, end double, word string")
    chunks = writers.caption_chunks(words, ["job_id"])
    assert sorted((r.chunk, r.start, r.end, r.text) for r in chunks.collect()) == [(0, 0.0, 0.9, "one {two}"), (1, 3.0, 3.5, "three")]
    writers.subtitle_lines(chunks).select("value").coalesce(1).write.text(str(tmp_path / "s"))
    got = readers.read_subtitles(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [(round(r.start, 2), round(r.end, 2), r.text) for r in got] == [(0.0, 0.9, "one two"), (3.0, 3.5, "three")]


def test_artifacts_replace_only_written_recordings(spark, tmp_path):
    path = str(tmp_path / "lib")
    for rows in ([("a", 1), ("b", 2)], [("b", 3)]):
        writers.write_artifacts({"clips": spark.createDataFrame(rows, "job_id string, x int")}, path)
    assert sorted((r.job_id, r.x) for r in spark.read.parquet(f"{path}/clips").collect()) == [("a", 1), ("b", 3)]
    assert sorted((r.job_id, r.rows) for r in spark.read.parquet(f"{path}/manifest").collect()) == [("a", 1), ("b", 1)]


def test_curves_and_peaks(spark):
    curve = spark.createDataFrame([("j", 1.0, 0.123456), ("j", 0.0, 1.0)], "job_id string, t double, value double")
    r = writers.curve_arrays(curve, ["job_id"], "t", "value").first()
    assert (r.timeline, r.score) == ([0.0, 1.0], [1.0, 0.12346])
    s = spark.createDataFrame([("j", i, v) for i, v in enumerate([0.0, -1.0, 0.5])], "job_id string, i long, v double")
    assert {r.bucket: r.level for r in writers.peak_bytes(s, ["job_id"], "i", "v", 2).collect()}[0] == 255


def test_rankers_learn_the_order(spark):
    rows = [(g, 10 * g + i, float(i >= 2), 1.0, [float(i), float(g)]) for g in range(4) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, id long, y double, w double, f array<double>")
    pairs = learning.preference_pairs(df, "g", "id", "y", "w", "f")
    assert pairs.count() == 4 * 4
    model = learning.fit_pairwise(pairs)
    scored = df.select("y", model.score(F.col("f")).alias("s")).collect()
    assert min(r.s for r in scored if r.y) > max(r.s for r in scored if not r.y)
    out = learning.leave_one_out(df, "g", "id", "y", "f", folds=4).collect()
    assert sorted(r.id for r in out) == sorted(r[1] for r in rows) and all(0 <= r.p <= 1 for r in out)


def test_json_arrays_are_read_record_by_record(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "x": "a"}, {"id": 2}]')
    (tmp_path / "b.json").write_text("[]")
    got = readers.read_json_array(spark, str(tmp_path), "id long, x string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, None)]
