"""Word timing against brute force over short lists; dominant directions against numpy."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamlens.operators import directions, speech


def best_mask(values):
    """The longest non-decreasing subsequence by quadratic search, earliest last element and earliest elements before it."""
    n = len(values)
    length, before = [1] * n, [-1] * n
    for i, j in itertools.product(range(n), range(n)):
        if j < i and values[j] <= values[i] and length[j] + 1 > length[i]:
            length[i], before[i] = length[j] + 1, j
    mask, at = [False] * n, max(range(n), key=lambda i: length[i]) if n else -1
    while at >= 0:
        mask[at], at = True, before[at]
    return mask


def test_trusted_values_are_the_longest_subsequence():
    for values in itertools.chain(itertools.product(range(4), repeat=5), ([random.Random(s).randint(0, 30) for _ in range(25)] for s in range(200)), [[]]):
        assert speech.trusted(np.array(values, float)).tolist() == best_mask(list(values))
    assert speech.trusted(np.array([5, np.nan, 6.0])).tolist() == [True, False, True]


def test_no_subsequence_is_longer():
    draw = random.Random(4)
    for _ in range(60):
        values = [draw.randint(0, 6) for _ in range(draw.randint(1, 9))]
        longest = max(len(c) for n in range(1, len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c))
        assert int(speech.trusted(np.array(values, float)).sum()) == longest


def test_repaired_times_never_fall(spark):
    cases = {1: [1, 2, 9, 3, 4], 2: [5, 1, 2, 3], 3: [1, 2, 3, 0], 4: [0, 50, 51, 52, 53, 10, 11, 12, 13, 14, 15], 5: [], 6: None, 7: [1, 2, 90, 80, 5, 6, 7], 8: [7], 9: [None, 4, None]}
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in cases.items()]
    got = {r.id: r.x for r in spark.createDataFrame(rows, "id long, f array<double>").select("id", speech.monotone_frames("f").alias("x")).collect()}
    assert got[1] == [1, 2, 2, 3, 4] and got[2] == [1, 1, 2, 3] and got[3] == [1, 2, 3, 3]
    assert got[4] == [0, 2, 4, 6, 8, 10, 11, 12, 13, 14, 15] and got[5] == [] and got[6] is None
    assert got[7] == [1, 2, 2, 5, 5, 6, 7] and got[8] == [7] and got[9] == [4, 4, 4]


def plain_reflow(words, limit):
    out, i = [list(w) for w in words], 0
    flat = [b - a <= speech.COLLAPSED for a, b in words]
    while i < len(words):
        if not flat[i]:
            i += 1
            continue
        j = next((k for k in range(i, len(words)) if not flat[k]), len(words))
        a, n = words[i][0], j - i
        stop = words[j][0] if j < len(words) else limit if limit is not None and limit > a else None
        pace = 0.5
        if j < len(words) and words[j][0] > a:
            pace = max(0.22, min(0.5, (words[j][0] - a) / n))
        elif j == len(words) and stop is not None:
            pace = min(0.5, (stop - a) / n)
        for k in range(i, j):
            s, e = a + (k - i) * pace, a + (k - i) * pace + pace
            out[k] = [min(s, stop), min(e, stop)] if stop is not None else [s, e]
        i = j
    return out


def test_collapsed_words_are_spread(spark):
    draw, rows, want = random.Random(6), [], {}
    for k in range(40):
        t, words = 0.0, []
        for _ in range(draw.randint(1, 12)):
            d = draw.choice([0.0, 0.0, 0.05, 0.4])
            words.append((t, t + d))
            t += draw.choice([0.0, 0.25, 1.0]) + d
        limit = draw.choice([None, t + 0.5, t + 5.0])
        rows += [(k, i, a, b, limit) for i, (a, b) in enumerate(words)]
        want |= {(k, i): tuple(v) for i, v in enumerate(plain_reflow(words, limit))}
    df = spark.createDataFrame(rows, "k long, i long, start double, end double, media double")
    got = {(r.k, r.i): (r.start, r.end) for r in speech.reflowed(df, ["k"], "media").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def plain_ties(data):
    data, i = list(data), 0
    while i < len(data):
        j = i
        while j + 1 < len(data) and data[j + 1] == data[i]:
            j += 1
        n = j - i + 1
        top = data[j + 1] if j + 1 < len(data) else data[i] + n
        if n > 2 and top > data[i]:
            data[i : j + 1] = [round(data[i] + (top - data[i]) / n * k) for k in range(n)]
        i = j + 1
    return data


def test_ties_are_spread(spark):
    draw, lists = random.Random(8), {}
    for k in range(40):
        lists[k] = sorted(draw.randint(0, 12) for _ in range(draw.randint(1, 15))) if k % 3 else [draw.randint(0, 3) for _ in range(9)]
    df = spark.createDataFrame([(k, i, f) for k, v in lists.items() for i, f in enumerate(v)], "k long, i long, frame long")
    got = {}
    for r in speech.spread_ties(df, ["k"]).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.frame)
    assert got == {k: plain_ties(v) for k, v in lists.items()}


def plain_edits(old, new):
    ops = []
    for tag, *span in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        ops.append([tag == "equal", *span])
    merged = []
    for op in ops:
        empty = op[1] == op[2] or op[3] == op[4]
        if merged and (empty or merged[-1][1] == merged[-1][2] or merged[-1][3] == merged[-1][4]):
            merged[-1] = [False, merged[-1][1], op[2], merged[-1][3], op[4]]
        else:
            merged.append(op)
    return merged


def test_edited_words_keep_or_share_times(spark):
    draw, cases = random.Random(3), []
    for k in range(80):
        old = [draw.choice("abcdeF") * draw.randint(1, 3) for _ in range(draw.randint(1, 10))]
        new = [draw.choice([w.upper(), w, "zz"]) for w in old if draw.random() < 0.8]
        new = new + ["end"] * draw.randint(0, 2) if draw.random() < 0.5 else ["go", *new]
        cases.append((k, [(f" {w}", float(i), i + 0.8) for i, w in enumerate(old)], " ".join(new)))
    cases += [(100, None, "a"), (101, [], "a"), (102, [("x", 1.0, 1.0)], ""), (103, [("x", 1.0, 2.0)], None), (104, [("x", 1.0, 1.0), ("y", 1.0, 1.0)], "p qq")]
    df = spark.createDataFrame(cases, "id long, words array<struct<word:string,start:double,end:double>>, text string")
    got = {r.id: [tuple(x) for x in r.x] for r in df.select("id", speech.retimed_words("words", "text").alias("x")).collect()}
    for k, words, text in cases[:80]:
        said, out = text.split(), []
        for same, i, i2, j, j2 in plain_edits([w.strip().lower() for w, *_ in words], [x.lower() for x in said]):
            a, b, sizes = words[i][1], words[i2 - 1][2], [len(x) for x in said[j:j2]]
            for n, x in enumerate(said[j:j2]):
                out.append((x, words[i + n][1], words[i + n][2]) if same else (x, a + (b - a) * sum(sizes[:n]) / sum(sizes), a + (b - a) * sum(sizes[: n + 1]) / sum(sizes)))
        assert [x[0] for x in got[k]] == said and all(x[1:] == pytest.approx(y[1:]) for x, y in zip(got[k], out, strict=True))
        if said:
            assert got[k][0][1] == words[0][1] and got[k][-1][2] == pytest.approx(words[-1][2])
    assert got[100] == got[101] == got[102] == got[103] == [] and got[104] == [("p", 1.0, 1.0), ("qq", 1.0, 1.0)]


def test_edited_words_hold_few_lines_at_once(spark, monkeypatch):
    """A batch's lines become Python objects a slice at a time; results of slices stand in order."""
    monkeypatch.setattr(speech, "LINES", 3)
    made = []
    udf = F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: made.append(f) or udf(kind)(f))
    speech.retimed_words(F.col("w"), F.col("t"))
    held, retime = [], speech.retime
    monkeypatch.setattr(speech, "retime", lambda w, t: held.append(t) or retime(w, t))
    lists = pa.array([[{"word": "a", "start": float(k), "end": k + 1.0}] if k % 4 else None for k in range(10)])
    got = made[0](lists, pa.array(["A b"] * 10)).to_pylist()
    assert len(held) == 10 and got == [retime([{"word": "a", "start": float(k), "end": k + 1.0}] if k % 4 else [], "A b") for k in range(10)]
    assert made[0](lists.slice(0, 0), pa.array([], pa.string())).to_pylist() == []


def plain_centre(v, rounds, share):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    centre = v.mean(axis=0)
    for _ in range(rounds):
        centre /= np.linalg.norm(centre)
        centre = v[np.lexsort((np.arange(len(v)), -np.round(v @ centre, 9)))[: max(1, int(len(v) * share + 1e-9))]].mean(axis=0)
    return centre / np.linalg.norm(centre)


def test_dominant_directions_equal_numpy(spark):
    draw = np.random.default_rng(5)
    sets = {k: draw.standard_normal((n, 4)) + draw.standard_normal(4) * 2 for k, n in ((1, 40), (2, 1), (3, 7))}
    sets[4] = np.repeat(sets[1][:3], 5, axis=0)  # ties
    rows = [(k, i, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)] + [(5, 0, [1.0, 0.0, 0.0, 0.0]), (5, 1, [-1.0, 0.0, 0.0, 0.0]), (6, 0, None), (6, 1, [1.0])]
    df = spark.createDataFrame(rows, "k long, id long, v array<double>").repartition(4)
    got = {r.k: r.centre for r in directions.dominant_directions(df, ["k"], "id", "v", 4).collect()}
    assert got.keys() == {1, 2, 3, 4}  # 5 has no mean direction, 6 no vectors
    for k in got:
        assert got[k] == pytest.approx(plain_centre(sets[k], 5, 0.3).tolist())


def test_shares_of_full_windows(spark):
    df = spark.createDataFrame([(1, 0.1, True), (1, 0.9, True), (1, 0.0, False), (2, 0.5, False)], "k long, s double, whole boolean")
    got = {r.k: (r.far, r.near) for r in directions.shares(df, ["k"], F.col("s"), F.col("whole"), 0.3, 0.6).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)}
