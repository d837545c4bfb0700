"""Hand-worked cases of regions under a bound or a budget, agreement over active channels, and times to look at."""

import random

import pytest
from pyspark.sql import functions as F

from streamlens.functions import moments
from streamlens.operators import intervals, packs, windows


def spans(spark, rows):
    return spark.createDataFrame(rows, "k long, start double, end double")


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_region_longer_than_the_bound_is_cut_only_on_request(spark):
    x = spans(spark, [(1, 0.0, 500.0), (1, 505.0, 520.0), (1, 525.0, 530.0)])
    assert listed(intervals.bounded_merge(x, ["k"], "start", "end", 12.0, 90.0, cut=True)) == [(1, 0.0, 90.0), (1, 505.0, 530.0)]
    assert listed(intervals.bounded_merge(x, ["k"], "start", "end", 12.0, 90.0)) == [(1, 0.0, 500.0), (1, 505.0, 530.0)]


def test_a_region_that_does_not_fit_does_not_end_the_filling(spark):
    first = spans(spark, [(1, 0.0, 10.0)])
    others = spans(spark, [(1, 100.0, 200.0), (1, 300.0, 400.0), (1, 500.0, 520.0), (2, 0.0, 900.0), (2, 5.0, 6.0)])
    got = listed(packs.priority_regions(first, others, ["k"], 150.0))
    assert got == [(1, 0.0, 10.0), (1, 100.0, 200.0), (1, 500.0, 520.0), (2, 0.0, 900.0), (2, 5.0, 6.0)]  # nothing comes first in 2


def test_first_regions_may_exceed_the_budget_and_join_others(spark):
    first = spans(spark, [(1, 0.0, 100.0), (1, 108.0, 300.0), (3, 7.0, 8.0)])
    others = spans(spark, [(1, 20.0, 40.0), (1, 95.0, 112.0), (1, 400.0, 401.0)])
    # 0-100 and 108-288 (cut to 180) are 280 seconds, more than the budget; only what adds no second is taken
    assert listed(packs.priority_regions(first, others, ["k"], 50.0)) == [(1, 0.0, 100.0), (1, 108.0, 288.0), (3, 7.0, 8.0)]


def test_agreement_counts_active_channels_only(spark):
    names = "k long, t double, score double, present boolean, face double, voice double, speech double, burst double, chat double, motion double, game_audio double, loud_onset double, startle double, game_evidence double"
    row = lambda k, t, voice, chat: (k, float(t), 0.5, False, 0.9, voice, 0.0, 0.0, chat, 0.0, 0.0, 0.0, 0.0, 0.0)
    frames = spark.createDataFrame([row(1, 0, 0.3, 0.0), row(1, 9, 0.0, 1.0), row(2, 0, 0.0, 0.0)], names)
    w = spark.createDataFrame([(1, 1, 0.0, 5.0, 1.0), (2, 2, 0.0, 5.0, 1.0), (2, 3, 50.0, 60.0, 55.0)], "k long, id long, start double, end double, pivot double")
    got = {r.id: (r.modalities, round(r.agreement, 6)) for r in windows.window_statistics(w, frames, ["k"]).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0), 3: (0, 0.0)}  # 1: voice and chat are active, faces were never present


def brute_looks(start, end, peak, witness, expected, n):
    d, centre = end - start, peak if start <= peak <= end else start + (end - start) * 0.55
    slots = {k: ("spread", start + d * (k / n)) for k in range(n)}
    slots[0] = ("opening", start + (0.5 if n == 2 else min(0.5, d * 0.05)))
    if n > 2:
        slots[max(1, n // 2 - 1)] = ("approach", centre - min(1.0, d * 0.08))
    slots[n // 2] = ("peak", centre)
    shown = witness if witness is not None else expected + 1.0 if expected is not None else None
    if n > 2 and shown is not None and start <= shown <= end:
        slots[min(n - 1, n // 2 + 1)] = ("banner", shown)
    edge, out = min(0.15, d * 0.02), []
    for t, role in sorted((round(max(start + edge, min(end - edge, t)), 3), role) for role, t in slots.values()):
        if not out or t - out[-1][0] >= 0.05:
            out.append((t, role))
    return out


@pytest.mark.parametrize("n", range(2, 9))
def test_look_times_equal_brute_force(spark, n):
    draw = random.Random(n)
    rows = []
    for k in range(60):
        start, d = draw.randint(0, 50) / 4, draw.choice([0.2, 1.0, 3.2, 20.0, 61.0])
        near = lambda: None if draw.random() < 0.4 else start + draw.randint(-8, 80) / 4  # noqa: E731, B023
        rows.append((k, start, start + d, start + draw.randint(-4, 80) / 4, near(), near()))
    x = spark.createDataFrame(rows, "id long, start double, end double, peak double, witness double, expected double")
    got = {r.id: [tuple(v) for v in r.t] for r in x.select("id", moments.look_times(*[F.col(c) for c in x.columns[1:]], n).alias("t")).collect()}
    for row in rows:
        want = brute_looks(*row[1:], n)
        assert [v[1] for v in got[row[0]]] == [v[1] for v in want] and [v[0] for v in got[row[0]]] == pytest.approx([v[0] for v in want], abs=2e-3)
