"""Results at a bar or a tie must not depend on the order in which rows arrive, nor a stage's memory on the number of channels."""

import contextlib
import io
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from streamlens import registry
from streamlens.functions import moments
from streamlens.functions.strings import tokens
from streamlens.operators import packs, search
from streamlens.operators import windows as win


def added(numbers):
    """The sum in the given order; Python's own sum() compensates from 3.12 on."""
    total = 0.0
    for x in numbers:
        total += x
    return total


def test_arousal_deals_frames_once_and_equals_a_plain_walk(spark):
    draw = random.Random(5)
    rows = [(k, float(t), draw.random(), draw.choice([0.0, 90.0, 120.0, 200.0]), draw.random(), draw.choice([0.0, 0.5])) for k in range(3) for t in range(40)] + [(None, 1.0, 0.5, 90.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k int, t double, rms double, pitch double, speech double, burst double")
    x = win.voice_arousal(df, ["k"], "t", "rms", "pitch", "speech", "burst", "arousal")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        x.explain()
    got = {(r.k, r.t): r.arousal for r in x.collect()}
    assert "Join" not in plan.getvalue() and plan.getvalue().count("Exchange hashpartitioning") == 1
    want = {}
    for k in range(3):
        f = np.array([r[1:] for r in rows if r[0] == k])
        rise = np.array([0.0] + [max(0.0, b - a) if a > 0 and b > 0 else 0.0 for a, b in zip(f[:-1, 2], f[1:, 2], strict=True)])
        total = 0.0
        for v, weight in ((f[:, 1], 0.45), (rise, 0.30), (f[:, 3], 0.15), (f[:, 4], 0.10)):
            z = (v - np.median(v)) / max(1e-6, 1.4826 * np.median(abs(v - np.median(v))))
            total = total + weight * (1 - np.exp(-np.clip(z, 0, 6) / 2))
        want |= {(k, t): v for t, v in zip(f[:, 0], total, strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_equally_strong_chat_windows_come_in_order_of_time(spark):
    """.1 + .2 + .3 is 0.6000000000000001, or .6 the other way round: neither is the stronger window."""
    says = [(1, 0.0, w) for w in (0.3, 0.2, 0.1)] + [(1, 10.0, w) for w in (0.1, 0.2, 0.3)]
    m = spark.createDataFrame(says, "k int, t double, weight double").coalesce(1).withColumns({"emotes": F.lit(2), "intent": F.lit(False), "phrase": F.lit(None).cast("string")})
    assert added([0.3, 0.2, 0.1]) < added([0.1, 0.2, 0.3])
    assert [r.start for r in win.chat_windows(m, ["k"], 10.0, 5, 1).collect()] == [0.0]


def test_mean_motion_at_the_bar_is_added_in_order_of_time(spark):
    """Run 1's motion of .1, .2 and .3 is the median, .2, on the average when added in time; the same run backwards falls short by a rounding error."""
    for motion, kept in (([0.1, 0.2, 0.3], True), ([0.3, 0.2, 0.1], False)):
        frames = [(1, float(t), 1.0, m) for t, m in enumerate(motion)] + [(1, 100.0 + t, 0.0, 0.2) for t in range(8)]
        for given in (frames, frames[::-1]):
            df = spark.createDataFrame(given, "k int, t double, game_audio double, motion double").coalesce(1)
            assert bool(win.encounters(df, ["k"], 0.1, 2.0, 1.0, 3).count()) == (added(motion) / 3 >= 0.2) == kept
            x = df.repartition(3)
            assert bool(win.encounters(x, ["k"], 0.1, 2.0, 1.0, 3).count()) == kept


def test_encounters_with_frames_of_one_time_equal_the_sql_on_one_thread(spark, tmp_path):
    """Each user's times come six times, with other motions: of such frames the SQL adds that with the smaller id first, as the table has them."""
    con = duckdb.connect(config={"threads": 1})
    once = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds((i * 1103515245 + 12345) % 2592000) AS ts, i * 7 % 40 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(3000) r(i)"
    con.execute(f"COPY (SELECT o.* REPLACE (event_id + 3001 * k AS event_id) FROM range(6) c(k), ({once}) o ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    found = con.execute(registry.oracle_sql()["combat_encounters"])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert want and sorted(tuple(r[c] for c in names) for r in registry.queries()["combat_encounters"](spark, str(tmp_path)).collect()) == want


def test_mean_voice_at_the_bar_is_added_in_order_of_id(spark):
    """Ten voices of .1, .2 ... whose sum meets .25 on the average, or falls short, by the order in which they are added."""
    draw = random.Random(1)
    while True:
        v = [draw.randint(0, 18) / 30 for _ in range(12)]
        if len({added(v) / 12 >= 0.25, added(v[::-1]) / 12 >= 0.25}) == 2:
            break
    for voices in (v, v[::-1]):
        rows = [(1, i, x) for i, x in enumerate(voices)]
        for given in (rows, rows[::-1]):
            df = spark.createDataFrame(given, "k int, id int, voice double").coalesce(1)
            off = {c: F.lit(False) for c in ("is_event", "verbal_payoff", "context_complete", "routine_only")}
            df = df.withColumns({**off, "verdict": F.lit(""), "moment_type": F.lit(""), "peak_value": F.lit(1.5), "face_max": F.lit(0.1), "startle": F.lit(0.0)})
            assert ("voice_face_reaction" in packs.content_shape(df, ["k"]).first().evidence) == (added(voices) / 12 >= 0.25)


def test_looks_round_the_double_and_not_its_decimals(spark):
    """4166.7125 as a double lies below the tie: times 1000 it is 4166712.4999999995."""
    t = 4166.7125
    looks = moments.look_times(F.lit(4100.0), F.lit(4200.0), F.lit(4150.0), F.lit(t), F.lit(None).cast("double"), 3)
    got = spark.range(1).select(looks.alias("x")).first().x
    assert [v.t for v in got if v.role == "banner"] == [round(t * 1000) / 1000] == [4166.712]


def test_hashed_rows_count_within_texts_and_join_rows_of_one_id(spark):
    """No term becomes a row; an id whose rows come in several batches has one row, texts without terms none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        texts = [(k % 5 if k % 6 else None, " ".join(f"w{(k * j) % 7}" for j in range(k))) for k in range(17)] + [(9, ""), (10, None)]
        d = spark.createDataFrame(texts, "doc_id long, text string")
        x = search.hashed_rows(d, "doc_id", tokens(F.col("text")))
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            x.explain()
        assert "Generate" not in plan.getvalue() and "Aggregate" not in plan.getvalue()
        got = {r.id: [(v.feature, round(v.value, 9)) for v in r.row] for r in x.collect()}
        counts = {}
        for i, t in texts:
            for w in (t or "").split():
                own = counts.setdefault(i, {})
                f = zlib.crc32(w.encode()) % search.FEATURES
                own[f] = own.get(f, 0) + 1
        assert got == {i: [(f, round(1 + math.log(n), 9)) for f, n in sorted(c.items())] for i, c in counts.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
