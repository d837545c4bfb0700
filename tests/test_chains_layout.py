"""Beats around events and chat regions against plain walks."""

import random

from streamlens.operators import chains, layout, profiles


def plain_beats(rows, gap, span):
    """rows: (id, start, end, event) of one recording."""
    nodes = {}
    for i, a, b, event in rows:
        if b > a:
            n = nodes.setdefault((round(a, 3), round(b, 3)), {"a": a, "b": b, "ids": [], "event": False})
            n["ids"].append(i)
            n["event"] |= event
    nodes = list(nodes.values())
    best = {}
    for seed in (n for n in nodes if n["event"]):
        a, b, taken = seed["a"], seed["b"], [seed]
        while True:
            away = lambda n: max(n["a"] - b, a - n["b"], 0.0)  # noqa: E731, B023
            left = [n for n in nodes if not any(n is x for x in taken) and away(n) <= gap and max(b, n["b"]) - min(a, n["a"]) <= span]
            if not left:
                break
            n = min(left, key=lambda n: (away(n), min(a, n["a"]), -n["b"]))  # noqa: B023
            taken.append(n)
            a, b = min(a, n["a"]), max(b, n["b"])
        if len(taken) > 1:
            ids = [i for n in taken for i in n["ids"]]
            for i in ids:
                if (len(taken), b - a) > best.get(i, (0, 0.0))[:2]:
                    best[i] = (len(taken), b - a, a, b, len(ids))
    return {i: (*best[i][2:4], best[i][4]) if i in best else (a, b, None) for i, a, b, _ in rows}


def test_causal_windows_equal_a_plain_growth(spark):
    draw, rows = random.Random(11), []
    for k in range(6):
        for i in range(draw.choice([1, 15, 40])):
            a = draw.randint(0, 600) / 2
            rows.append((k, 1000 * k + i, i, a, a + draw.choice([0.0, 5.0, 12.0, 30.0]), draw.random() < 0.3))
    df = spark.createDataFrame(rows, "k long, id long, place int, start double, end double, event boolean").repartition(3)
    got = {r.id: (r.start, r.end, r.members) for r in chains.causal_windows(df, ["k"], 4.0, 60.0).collect()}
    want = {}
    for k in range(6):
        want |= plain_beats([(i, a, b, e) for kk, i, _, a, b, e in rows if kk == k], 4.0, 60.0)
    assert got == want and any(v[2] for v in want.values())


def test_chat_regions_are_joined_cells_that_change(spark):
    rows = []
    for t in range(30):
        rows += [(1, t, 1500.0, y, 1800.0, y + 40, f"line {t} says {y}") for y in (100.0, 160.0, 220.0)]  # a chat
        rows += [(1, t, 0.0, 900.0, 100.0, 940.0, "SCORE NOW"), (1, t, 700.0, 500.0, 760.0, 540.0, f"{t}")]  # never changes; one word
        rows += [(2, t % 5, 10.0, 10.0, 200.0, 40.0, f"few frames {t}")]
    boxes = spark.createDataFrame([*rows, (1, 3, None, 1.0, 2.0, 3.0, "x y"), (1, 4, 1.0, 1.0, 2.0, 3.0, "")], "k long, t long, x1 double, y1 double, x2 double, y2 double, text string")
    got = layout.chat_regions(boxes, ["k"]).collect()
    assert len(got) == 1 and got[0].k == 1
    r = got[0]
    assert r.x <= 1500 / 1890 <= r.x + r.w and r.y <= 100 / 987 and r.y + r.h >= 240 / 987 and r.h < 0.5 and r.x > 0.6
    assert layout.chat_regions(boxes.where("false"), ["k"]).count() == 0


def test_profile_of_unknown_events_and_decisions(spark):
    i = spark.createDataFrame([("impression", "q", "a", ["x"]), ("open", "q", "a", ["x", "y"]), ("other", None, "b", None)], "event string, query string, stable_key string, keys array<string>")
    c = spark.createDataFrame([(["x"], True, None, None, True, 1), (["x"], None, True, None, None, 0), (["y"], None, None, None, None, 0)], "keys array<string>, kept boolean, passed boolean, maybe boolean, exported boolean, compilations int")
    got = {(r.part, r.key): (r.impressions, r.actions, r.signal, r.n) for r in profiles.learning_profile(i, c).collect()}
    assert got["direct", "a"] == (1.0, 0.45, None, 2) and got["direct", "b"] == (0.0, 0.0, None, 1) and got["feature", "y"] == (0.0, 0.45, None, 1)
    assert got["editorial", "x"] == (None, None, 0.0, 2) and ("editorial", "y") not in got
    assert ("direct", "a") not in {(r.part, r.key) for r in profiles.learning_profile(i, c, "q").collect()}
