"""Window, pack and measure operators on hand-worked rows, and against plain Python."""

import random

import pytest

from streamlens.operators import editorial, library, measures, packs, planning, search, windows


def test_running_counts_equal_plain_sums(spark):
    rng = random.Random(1)
    rows = [(v, rng.randint(0, 9), rng.randint(0, 3)) for v in rng.sample(range(1000), 300)]
    got = {r.v: (r.p_before, r.n_before) for r in measures.running_counts(spark.createDataFrame(rows, "v int, p int, n int"), "v", ["p", "n"], 7).collect()}
    assert got == {v: (sum(p for w, p, _ in rows if w < v), sum(n for w, _, n in rows if w < v)) for v, _, _ in rows}
    one = measures.nearest_rank_of(spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 7)], "v double"), "v", 0.95)
    assert one.first().value == 9.0 and measures.nearest_rank_of(spark.createDataFrame([], "v double"), "v", 0.5).first().value is None


@pytest.mark.parametrize("floor,shared", [(0.45, 3), (0.2, 1), (0.8, 2)])
def test_sketch_pairs_equal_all_pairs(spark, floor, shared):
    rng = random.Random(int(floor * 100))
    rows = [(i, sorted(rng.sample([f"h{k}" for k in range(14)], rng.randint(1, 8)))) for i in range(60)]
    want = {}
    for i, a in rows:
        for j, b in rows:
            both = len(set(a) & set(b))
            if i < j and both >= shared and both / len(set(a) | set(b)) >= floor:
                want[i, j] = round(both / len(set(a) | set(b)), 9)
    got = {(r.a, r.b): round(r.similarity, 9) for r in search.sketch_pairs(spark.createDataFrame(rows, "id long, k array<string>"), "id", "k", shared, floor).collect()}
    assert got == want


def test_montage_is_greedy_in_every_stretch(spark):
    rng = random.Random(5)
    rows = [(k, i, round(rng.random() * 400, 2), round(rng.random() * 10, 3)) for k in "ab" for i in range(80)]
    got = {}
    for r in packs.montage(spark.createDataFrame(rows, "k string, moment int, at double, strength double"), ["k"], 8.0, 64.0, 12).collect():
        got.setdefault(r.k, []).append((r.position, r.moment))
    for k in "ab":
        taken = []
        for _, i, at, s in sorted((x for x in rows if x[0] == k), key=lambda x: (-x[3], x[2], x[1])):
            if len(taken) < 8 and all(abs(at - t) >= 8 for _, t, _ in taken):
                taken.append((i, at, s))
        order = [taken[0][0], *(i for i, _, _ in sorted(taken[1:], key=lambda x: x[1]))]
        assert [m for _, m in sorted(got[k])] == order


def test_windows_without_frames_are_all_dead_air(spark):
    w = spark.createDataFrame([("a", 1, 0.0, 10.0, 5.0), ("b", 2, 0.0, 10.0, 5.0)], "k string, id int, start double, end double, pivot double")
    names = ["score", "face", "voice", "speech", "burst", "chat", "motion", "game_audio", "loud_onset", "startle", "game_evidence"]
    f = spark.createDataFrame([("a", 3.0, True, *[0.5] * len(names)), ("a", 10.0, False, *[1.0] * len(names)), ("a", 10.5, True, *[9.0] * len(names))], "k string, t double, present boolean, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r for r in windows.window_statistics(w, f, ["k"]).collect()}
    assert (got[2].dead_air, got[2].modalities, got[2].face) == (1.0, 0, 0.0)
    assert (got[1].face, got[1].face_max, got[1].voice, got[1].lead, got[1].settle, got[1].dead_air, got[1].hook_energy) == (0.5, 0.5, 0.75, 0.5, 1.0, 0.0, 0.5)


def test_trims_keep_the_peak_and_onsets_stop_at_pauses(spark):
    frames = [("a", float(t), 1.0 if 12 <= t <= 40 else 0.1, 0.0) for t in range(61)]
    f = spark.createDataFrame(frames, "k string, t double, rms double, voice double")
    w = spark.createDataFrame([("a", 1, 0.0, 60.0, 20.0), ("a", 2, 0.0, 60.0, 2.0), ("a", 3, 50.0, 55.0, 52.0)], "k string, id int, start double, end double, peak double")
    got = {r.id: (r.start, r.end) for r in windows.trim_dead_air(w, f, ["k"]).collect()}
    assert got == {1: (11.0, 41.2), 2: (0.0, 41.2), 3: (50.0, 55.0)}
    loud = [("a", float(t), 9.0 if t in (5, 20, 28, 36) else 1.0) for t in range(41)]
    a = spark.createDataFrame([("a", 7, 40.0)], "k string, id int, anchor double")
    assert [r.onset for r in windows.action_onsets(a, spark.createDataFrame(loud, "k string, t double, rms double"), ["k"]).collect()] == [18.0]


def test_sentences_end_at_marks_pauses_and_the_last_word(spark):
    rows = [("a", "Hello", 0.0, 0.3), ("a", "there.", 0.4, 0.7), ("a", "No", 0.8, 1.0), ("a", "end", 3.0, 3.2), ("a", "here\"", 3.3, 3.5), ("b", "x", 1.0, 1.1)]
    got = sorted((r.k, r.start, r.end) for r in windows.sentences(spark.createDataFrame(rows, "k string, word string, start double, end double"), ["k"]).collect())
    assert got == [("a", 0.0, 0.7), ("a", 0.8, 1.0), ("a", 3.0, 3.5), ("b", 1.0, 1.1)]


def test_plans_of_empty_and_null_queries(spark):
    from pyspark.sql import functions as F

    q = spark.createDataFrame([(1, None), (2, ""), (3, "best clips I kept last month with the boss after a scream")], "id int, text string")
    p = {r.id: r for r in planning.plan_filters(q, "text", F.lit("2024-03-31").cast("date")).collect()}
    assert (p[1].rest, p[2].kind, p[3].decision, p[3].sort, str(p[3].date_from), str(p[3].date_to)) == ("", None, "kept", "best", "2024-02-01", "2024-02-29")
    c = {r.id: r for r in planning.plan_clauses(q, "text", F.lit(False)).collect()}
    assert c[1].clauses == [] and c[3].clauses == ["creator_reaction", "boss"]
    given = planning.plan_filters(q, "text", F.lit("2024-03-31").cast("date"), {"decision": "passed"}).where("id = 3").first()
    assert given.decision == "passed" and "kept" not in given.rest


def test_reorder_wants_every_item_once(spark):
    items = spark.createDataFrame([(1, 0), (2, 1)], "id int, position int")
    assert sorted((r.id, r.position) for r in library.reorder(items, [2, 1], "id", "position").collect()) == [(1, 1), (2, 0)]
    for wrong in ([1], [1, 1], [1, 2, 3]):
        with pytest.raises(ValueError):
            library.reorder(items, wrong, "id", "position")


def test_a_calm_win_does_not_bypass_gates(spark):
    from pyspark.sql import functions as F

    from streamlens.operators import candidates

    rows = [(1, "VICTORY ROYALE", 0.0, 0.5), (2, "Victory", 0.3, 0.5), (3, "You placed #8", 0.3, 5.0)]
    c = candidates.with_score(candidates.complete(spark.createDataFrame(rows, "id int, onscreen string, startle double, peak_value double").withColumns({"start": F.lit(0.0), "end": F.lit(20.0), "verdict": F.lit("post"), "outcome": F.lit("match_win")})))
    got = {r.id: (r.visual_win, r.gate_bypass) for r in editorial.with_evidence(c).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False)}
