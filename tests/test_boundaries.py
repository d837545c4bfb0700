"""The chain from arcs to shown windows against plain walks over random recordings."""

import random
import statistics

import pytest

from streamlens.operators import boundaries as bd

B = bd.Bounds()


def recording(draw, n=160):
    return [(float(t), draw.randint(1, 40) / 10, draw.random() < 0.25, draw.randint(-8, 30) / 10, draw.choice([None] * 12 + ["elimination", "knock", "other"])) for t in range(n) if draw.random() < 0.95]


def frames_of(spark, recordings):
    return spark.createDataFrame([(k, *r) for k, rows in recordings.items() for r in rows], "k long, t double, rms double, cut boolean, score double, label string").repartition(3)


def quiet(target, rows):
    near = [r for r in rows if target - B.reach <= r[0] <= target + B.reach]
    if not near:
        return target
    low = min(near, key=lambda r: (r[1], r[0]))
    cuts = [r for r in near if r[2] and r[1] <= low[1] * B.near_quiet + 1e-9]
    return min(cuts, key=lambda r: (abs(r[0] - target), r[0]))[0] if cuts else low[0]


def plain_window(rows, start, end, peak, anchor, label, settle):
    event = label in bd.EVENTS and anchor is not None
    settle = settle if event else None
    a, e = min(quiet(start - 2.5, rows), peak - 4.5), max(quiet(end + 3.0, rows), peak + 2.0)
    lead, tail, most = (7.5, 5.0, 42.0) if event else (4.5, 2.0, 90.0)
    if settle is not None:
        tail = max(2.0, min(5.0, settle - anchor))
    if anchor is not None:
        a, e = min(a, anchor - lead), max(e, anchor + tail)
    if settle is not None and e > settle:
        e = max(quiet(settle, rows), anchor + 2.0, peak + 2.0)
    a = max(0.0, a)
    short = e - a < 8.0
    if short:
        a = max(0.0, min(quiet(a - (8.0 - (e - a)), rows), e - 8.0 + 3.0))
        e = max(e, a + 8.0)
    elif e - a > most:
        a = max(a, e - most)
        if a > peak - 4.5:
            a = max(0.0, peak - 4.5)
            e = a + most
        if anchor is not None:
            a, e = min(a, max(0.0, anchor - lead)), max(e, anchor + tail)
            a = max(0.0, e - most) if e - a > most else a
    return round(a, 3), round(e, 3), short


def test_snapped_windows_equal_a_plain_chain(spark):
    draw = random.Random(2)
    recs = {k: recording(draw) for k in range(4)}
    arcs, want = [], {}
    for i in range(150):
        k, start, d = draw.randrange(4), draw.randint(0, 150) / 1.0, draw.choice([0.0, 3.0, 12.0, 60.0, 120.0])
        anchor = draw.choice([None, start + draw.randint(0, 30)])
        arcs.append((k, i, start, start + d, start + d * draw.choice([0.0, 0.5, 1.0]), anchor, draw.choice([None, "knock", "other"]), None if anchor is None or draw.random() < 0.5 else anchor + draw.randint(2, 9)))
        want[i] = plain_window(recs[k], *arcs[-1][2:])
    df = spark.createDataFrame(arcs, "k long, id long, start double, end double, peak double, anchor double, label string, settle double")
    got = {r.id: (r.start, r.end, r.padded) for r in bd.snapped_windows(df, frames_of(spark, recs), ["k"]).collect()}
    assert got == {i: (pytest.approx(a), pytest.approx(e), s) for i, (a, e, s) in want.items()}
    assert len({s for *_, s in want.values()}) == 2
    alone = bd.snapped_windows(df.where("id < 5"), frames_of(spark, recs).where("false").drop("cut"), ["k"])  # no frames: nothing is moved to them
    assert {r.id: (r.start, r.end, r.padded) for r in alone.collect()} == {i: plain_window([], *arcs[i][2:]) for i in range(5)}


def test_context_keeps_the_selection_and_adds_sentences(spark):
    draw = random.Random(9)
    recs, spoken, windows, want = {k: recording(draw) for k in range(3)}, {}, [], {}
    for k in range(3):
        t, spoken[k] = 0.0, []
        while t < 150:
            d = draw.choice([1.0, 3.0, 6.0, 14.0])
            spoken[k].append((t, t + d))
            t += d + draw.choice([0.25, 1.5, 3.5, 6.0])
    for i in range(120):
        k, a = draw.randrange(3), draw.randint(5, 130) / 1.0
        windows.append((k, i, a, a + draw.choice([6.0, 30.0, 80.0, 88.0]), draw.random() < 0.7, draw.random() < 0.7))
    for k, i, start, end, lead, tail in windows:
        a, e, s = start, end, spoken[k]
        before = [x for x in s if x[0] < start - 0.05]
        if lead and before and (before[-1][1] >= start - 0.05 or 0 <= start - before[-1][1] <= 4) and start - before[-1][0] <= 12:
            a = max(0.0, min(before[-1][0] - 0.25, quiet(before[-1][0] - 1.0, recs[k]), start))
        after = [n for n, x in enumerate(s) if x[1] > end + 0.05]
        if tail and after and 0 <= s[after[0]][0] - end <= 4 and s[after[0]][1] - end <= 12:
            n = after[0]
            while n + 1 < len(s) and n - after[0] < 2 and 0 <= s[n + 1][0] - s[n][1] <= 2.5 and s[n + 1][1] - end <= 12:
                n += 1
            e = min(recs[k][-1][0], max(s[n][1] + 0.35, quiet(s[n][1] + 1.0, recs[k]), end))
        if e - a > 90:
            a, e = (a, end) if end - a <= 90 else (start, e) if e - start <= 90 else (start, end)
        want[i] = (round(a, 3), round(e, 3))
    df = spark.createDataFrame(windows, "k long, id long, start double, end double, lead boolean, tail boolean")
    sp = spark.createDataFrame([(k, *x) for k, v in spoken.items() for x in v], "k long, start double, end double")
    got = {r.id: (r.start, r.end) for r in bd.with_context(df, sp, frames_of(spark, recs), ["k"]).collect()}
    assert got == {i: pytest.approx(v) for i, v in want.items()} and sum(want[i] != w[2:4] for i, w in enumerate(windows)) > 30
    none = bd.with_context(df, sp.where("false"), frames_of(spark, recs), ["k"]).collect()
    assert {r.id: (r.start, r.end) for r in none} == {w[1]: w[2:4] for w in windows}


def plain_onset(rows, anchor):
    near = [r for r in rows if anchor - 40 <= r[0] <= anchor]
    if not near or statistics.median(r[1] for r in near) <= 0:
        return None
    bar, at, first = statistics.median(r[1] for r in near) * 1.8, anchor, None
    for r in sorted(near, reverse=True):
        if r[1] >= bar - 1e-12:
            if at - r[0] > 12:
                break
            at = first = r[0]
    return None if first is None else first - 2.0


def test_events_are_reopened_where_the_fight_begins(spark):
    draw = random.Random(5)
    recs = {k: recording(draw) for k in range(3)}
    windows = [(draw.randrange(3), i, float(a), a + draw.choice([10.0, 50.0, 70.0]), float(a + 6), draw.choice(["knock", "elimination", "other", None])) for i in range(60) for a in [draw.randint(20, 90)]]
    want = {}
    for k, i, start, end, anchor, label in windows:
        onset = plain_onset(recs[k], anchor) if label in bd.EVENTS else None
        new = max(0.0, quiet(onset, recs[k])) if onset is not None and onset < start else start
        new = max(0.0, end - 58.0) if new < start and end - new > 58 else new
        want[i] = round(new, 3) if new < start else start
    df = spark.createDataFrame(windows, "k long, id long, start double, end double, anchor double, label string")
    got = {r.id: r.start for r in bd.reopened(df, frames_of(spark, recs), ["k"]).collect()}
    assert got == want and any(want[w[1]] < w[2] for w in windows)


def test_wins_begin_with_the_play_before_them(spark):
    draw = random.Random(7)
    recs = {k: recording(draw) for k in range(3)}
    anchors, want = [(draw.randrange(3), i, float(draw.randint(0, 158))) for i in range(60)], {}
    for k, i, anchor in anchors:
        m = statistics.median(r[3] for r in recs[k])
        bar = max(0.45, m + 0.35 * 1.4826 * statistics.median(abs(r[3] - m) for r in recs[k]))
        active = [r[0] for r in recs[k] if max(0.0, anchor - 24) <= r[0] <= max(0.0, anchor - 2) and (r[3] >= bar or r[4] in bd.EVENTS)]
        while active and any(b - a > 3 for a, b in zip(active, active[1:], strict=False)):
            active = active[1:]
        want[i] = min(max(0.0, active[0] - 3), max(0.0, anchor - 10)) if active else max(0.0, anchor - 14)
    df = spark.createDataFrame(anchors, "k long, id long, anchor double")
    assert {r.id: r.start for r in bd.win_leads(df, frames_of(spark, recs), ["k"]).collect()} == want


def test_a_marker_credits_the_strongest_window_only(spark):
    draw = random.Random(3)
    recs = {k: recording(draw) for k in range(3)}
    markers = [(draw.randrange(3), i, float(a), a + draw.choice([0.0, 30.0])) for i in range(50) for a in [draw.randint(0, 170)]]
    windows = [(draw.randrange(3), i, float(a), a + 12.0, draw.choice([None, 1.0, 2.0])) for i in range(12) for a in [draw.randint(0, 150)]]
    want = {}
    for k, i, lo, hi in markers:
        rows = [r for r in recs[k] if lo <= r[0] <= hi]
        if not rows:
            continue
        peak = min(rows, key=lambda r: (-r[3], r[0]))[0]
        held = [w for w in windows if w[0] == k and w[2] <= peak <= w[3]]
        if held:
            w = min(held, key=lambda w: (-(w[4] or 0.0), w[1]))
            want[i] = (peak, w[1], w[2], w[3])
            continue
        at = [r[0] for r in recs[k]].index(peak)
        a = e = at
        if recs[k][at][3] > 0.5:
            while a > 0 and recs[k][a - 1][3] > 0.5:
                a -= 1
            while e + 1 < len(recs[k]) and recs[k][e + 1][3] > 0.5:
                e += 1
        want[i] = (peak, None, recs[k][a][0], recs[k][e][0])
    m = spark.createDataFrame(markers, "k long, marker long, lo double, hi double")
    w = spark.createDataFrame(windows, "k long, id long, start double, end double, auc double")
    got = {r.marker: (r.peak, r.id, r.start, r.end) for r in bd.marked(m, frames_of(spark, recs), w, ["k"], 0.5).collect()}
    assert got == want
