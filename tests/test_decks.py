"""Whole decks, and each of their steps, against a plain walk over random recordings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streamlens.operators import decks

M, D = decks.Moment(), decks.Deck(ceiling=4, recovery=3, band=2, rich_events=2, least_score=0.2, floor=0.6, rich_floor=0.9)
FLAGS = ["creator", "visual_win", "landed_event", "face_spike", "strong_startle", "crowd_anchor", "spoken_beat", "passes", "exempt", "face_rescue", "publishable", "protected", "is_event", "consensus", "terminal", "anchored_win", "ordinary"]


def recordings(seed):
    draw = random.Random(seed)
    rows = []
    for k in range(4):
        for i in range(draw.choice([1, 7, 30, 45])):
            start = draw.randint(0, 6000) / 1.0
            row = {"k": k, "id": 100 * k + i, "start": start, "end": start + draw.choice([8.0, 20.0, 45.0, 70.0]), "score": draw.randint(0, 40) / 8, "crowd_clip": draw.choice([0, 0, 0, 2]), "payoff": draw.randint(0, 4) / 4, "visual_payoff": draw.randint(0, 4) / 4}
            row |= {f: draw.random() < {"passes": 0.8, "publishable": 0.7, "is_event": 0.5, "consensus": 0.5, "ordinary": 0.6, "spoken_beat": 0.4}.get(f, 0.12) for f in FLAGS}
            row["protected"] = row["protected"] or row["creator"]
            row |= {"peak": start + 5.0, "anchor": draw.choice([None, start + 3.0]), "label": draw.choice([None, "elimination", "knock"]), "tokens": draw.sample("abcde", draw.choice([0, 3, 4])), "profile": draw.choice(["generic", "generic", "shooter"]) if k == 3 else "generic"}
            rows.append(row)
    return rows


def share(a, b):
    return max(0.0, min(a["end"], b["end"]) - max(a["start"], b["start"])) / min(a["end"] - a["start"], b["end"] - b["start"])


def apart(a, b):
    return max(0.0, a["start"] - b["end"], b["start"] - a["end"])


def together(a, b):
    return max(a["end"], b["end"]) - min(a["start"], b["start"])


def near(a, b):
    return together(a, b) <= 60 + 1e-9 and (share(a, b) > 0.3 or apart(a, b) <= 12)


def alike(a, b):
    both, every = set(a["tokens"]) & set(b["tokens"]), set(a["tokens"]) | set(b["tokens"])
    return apart(a, b) <= 45 and together(a, b) <= 120 and len(both) >= 3 and len(both) / len(every) >= 0.45


def same(a, b):
    close = a["anchor"] is not None and b["anchor"] is not None and abs(a["anchor"] - b["anchor"]) <= 8 and (not a["label"] or not b["label"] or a["label"] == b["label"])
    return together(a, b) <= 120 and (near(a, b) or close or alike(a, b))


def strength(r):
    return (*(r[c] for c in decks.EVIDENCE), r["score"], -r["start"])


def floors(rows):
    def cut(rows, where, best, part, name):
        floor = max(D.least_score, (best or 0) * part)
        for r in [r for r in rows if r["said"] == "eligible" and where(r)]:
            if not (r["exempt"] or r["protected"] or r["score"] >= floor):
                r["said"], r["rescued"] = ("eligible", True) if r["face_rescue"] else (name, r["rescued"])

    for r in rows:
        r["said"], r["rescued"] = "eligible" if r["passes"] else "gated", False
    left = [r for r in rows if r["said"] == "eligible"]
    plain = [r for r in left if not r["visual_win"] and not r["crowd_clip"]] or left
    if len(left) > D.ceiling:
        cut(rows, lambda r: True, max(r["score"] for r in plain), D.floor, "adaptive_quality_floor")
    marks = []
    for t in sorted(r["peak"] if r["anchor"] is None else r["anchor"] for r in rows if r["said"] == "eligible" and r["is_event"] and not r["visual_win"]):
        if not marks or t - marks[-1] > D.event_gap:
            marks.append(t)
    known = any(r["said"] == "eligible" and r["profile"] != "generic" for r in rows) and len(marks) >= D.rich_events
    for r in rows:
        r["rich"] = known or sum(abs(t - r["peak"]) <= D.rich_window / 2 for t in marks) >= D.rich_events
    cut(rows, lambda r: r["rich"], max((r["score"] for r in rows if r["said"] == "eligible" and r["rich"]), default=0), D.rich_floor, "event_rich_floor")
    missing = D.recovery - sum(r["said"] == "eligible" for r in rows)
    lost = sorted((r for r in rows if r["said"].endswith("floor") and r["publishable"]), key=lambda r: (strength(r), -r["id"]), reverse=True)
    rescued = [r for r in rows if r["said"] == "eligible" and r["rescued"]]
    for r in lost[: max(0, missing)]:
        r["said"] = "eligible"
    for r in rescued:
        r["score"] += D.rescue_bonus
    return [r for r in rows if r["said"] == "eligible"]


def grouped(rows):
    for r in sorted((r for r in rows if r["protected"] and not r["creator"]), key=lambda r: (-r["score"], r["id"]))[math.ceil(D.ceiling * D.command_share) :]:
        r["protected"] = False
    rows = sorted(rows, key=lambda r: (not r["protected"], not r["anchored_win"], -r["score"], r["id"]))
    groups = []
    for place, r in enumerate(rows, 1):
        r["place"] = place
        home = next((g for g in groups if any(same(r, x) for x in g)), None)
        r["source"] = "seed" if home is None else "tokens" if any(alike(r, x) for x in home) else "temporal"
        if home is None:
            groups.append(home := [])
        home.append(r)
        r["group"] = home[0]["place"] if len(home) > 1 else place
    for g in groups:
        if len(g) < 2:
            continue
        best, first, crowd = max(g, key=lambda r: (strength(r), -r["place"])), g[0], max(r["crowd_clip"] for r in g)
        if crowd:
            for r in g:
                if r is not best and r["crowd_clip"] and not r["creator"]:
                    r["protected"] = False
            best["protected"], best["crowd_clip"] = True, crowd
        if best is not first:
            best["place"], first["place"] = first["place"], best["place"]
            best["source"] += ":representative"
            first["source"] += ":alternate"
    return sorted(rows, key=lambda r: r["place"])


def walked(rows):
    chosen, behind = [], 0
    for r in rows:
        covered = any(share(r, c) > 0.3 for c in chosen)
        if len(chosen) >= D.ceiling:
            r["said"] = "overlap_suppressed" if covered else "moment_duplicate" if any(c["group"] == r["group"] for c in chosen) else "clip_ceiling" if behind < D.band else "editorial_overflow_cutoff"
            behind += 1
            continue
        keeper = next((c for c in chosen if near(r, c)), None)
        if keeper:
            r["said"] = "overlap_suppressed" if share(r, keeper) > 0.3 else "nearby_moment_merged"
            keeper["start"], keeper["end"] = min(r["start"], keeper["start"]), max(r["end"], keeper["end"])
        elif covered:
            r["said"] = "overlap_suppressed"
        elif r["source"] == "tokens" and any(c["group"] == r["group"] for c in chosen):
            r["said"] = "moment_duplicate"
        elif r["rich"] and not r["is_event"] and not r["ordinary"] and not r["protected"]:
            r["said"] = "event_rich_admission"
        else:
            r["said"] = "selected_protected" if r["protected"] else "selected_primary"
            chosen.append(r)
    return rows


def swapped(rows):
    mid = lambda r: (r["start"] + r["end"]) / 2
    for _ in range(D.rescues):
        deck = sorted((r for r in rows if r["said"].startswith("selected")), key=lambda r: (r["start"], r["place"]))
        if len(deck) < max(2, D.ceiling):
            return
        spacing = (mid(deck[-1]) - mid(deck[0])) / (len(deck) - 1)
        comes = None
        for room, a, b in sorted(((b["start"] - a["end"], a, b) for a, b in zip(deck, deck[1:], strict=False)), key=lambda x: -x[0]):
            if spacing <= 0 or room < D.gap_times * spacing or room <= 0:
                break
            lo, hi = a["end"], b["start"]
            found = [r for r in rows if not r["said"].startswith("selected") and r["consensus"] and lo + D.edge * room <= mid(r) <= hi - D.edge * room]
            if found:
                comes = max(found, key=lambda r: (r["payoff"], r["visual_payoff"], min(mid(r) - lo, hi - mid(r)), r["score"], -r["place"]))
                break
        lone = lambda r: min(abs(mid(r) - mid(x)) for x in deck if x is not r)  # noqa: B023, E731
        loose = [r for r in deck if not r["protected"] and not r["visual_win"] and not r["terminal"] and lone(r) <= spacing]
        if comes is None or not loose:
            return
        goes = min(loose, key=lambda r: (r["consensus"], r["score"], lone(r), r["place"]))
        goes["said"], comes["said"] = "temporal_blackout_rebalanced", "selected_temporal_rescue"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_decks_equal_a_plain_walk(spark, seed):
    rows = recordings(seed)
    kinds = {"k": "long", "id": "long", "crowd_clip": "int", "label": "string", "tokens": "array<string>", "profile": "string"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'boolean' if c in FLAGS else 'double')}" for c in rows[0])
    got = {r.id: r for r in decks.deck(spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3), ["k"], None, D, M, 600.0).collect()}
    said = set()
    for k in range(4):
        own = [dict(r) for r in rows if r["k"] == k]
        done = walked(grouped(floors(own)))
        swapped(done)
        for r in own:
            g = got[r["id"]]
            assert (g.disposition, g.group, g.place, g.start, g.end) == (r["said"], r.get("group"), r.get("place"), r["start"], r["end"]), (k, r["id"])
            said.add(r["said"])
        chosen = sorted((r for r in own if r["said"].startswith("selected")), key=lambda r: (r["start"], r["id"]))
        assert [got[r["id"]].rank for r in chosen] == list(range(1, len(chosen) + 1))
    assert len(got) == len(rows) and len(said) >= 7


def test_decks_of_no_rows_and_null_fields(spark):
    kinds = {"crowd_clip": "int", "label": "string", "tokens": "array<string>", "profile": "string", "k": "long", "id": "long"}
    names = [*recordings(1)[0]]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'boolean' if c in FLAGS else 'double')}" for c in names)
    assert decks.deck(spark.createDataFrame([], schema), ["k"], None, D, M).count() == 0
    bare = {"k": 1, "id": 1, "start": 0.0, "end": 9.0, "peak": 5.0, "score": 1.0, "passes": True, "protected": False, "creator": False, "is_event": False, "ordinary": True}
    one = decks.deck(spark.createDataFrame([tuple(bare.get(c) for c in names)], schema), ["k"], None, D, M).collect()
    assert [(r.disposition, r.rank) for r in one] == [("selected_primary", 1)]


def test_stretches_are_walked_apart(spark):
    far = [(1, i, i + 1, 1000.0 * i, 1000.0 * i + 10, None, None, ["a", "b", "c"]) for i in range(400)]
    x = spark.createDataFrame(far, "k long, id long, place long, start double, end double, anchor double, label string, tokens array<string>")
    assert decks.moment_groups(x, ["k"]).where(F.col("source") != "seed").count() == 0
