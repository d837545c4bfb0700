"""Ordered selection, hand-worked: decks, compilations, matches, long arcs and boxes."""

from streamlens.operators import selection


def test_suppress_gives_every_row_a_disposition(spark):
    rows = [
        ("j", 1, 0.0, 30.0, 9.0, True),  # first by score
        ("j", 2, 20.0, 50.0, 8.0, True),  # a third of it covered by 1
        ("j", 3, 35.0, 55.0, 7.0, True),  # within the gap, the union stays short
        ("j", 4, 200.0, 220.0, 6.0, False),
        ("j", 5, 200.0, 220.0, 5.0, True),
        ("j", 6, 400.0, 420.0, 5.0, True),  # equal score: the smaller id first, then beyond the ceiling
        ("k", 7, 0.0, 0.0, 1.0, True),
    ]
    df = spark.createDataFrame(rows, "job string, id long, start double, end double, score double, passes boolean")
    got = {r.id: (r.disposition, r.rank) for r in selection.suppress(df, ["job"], ceiling=2).collect()}
    assert got == {1: ("selected", 1), 2: ("suppressed", None), 3: ("merged", None), 4: ("gated", None), 5: ("selected", 2), 6: ("overflow", None), 7: ("selected", 1)}


def test_diverse_top_obeys_caps_titles_overlaps_and_budget(spark):
    rows = [
        ("c", 1, "a", "Win", 0.0, 10.0, 1, 0.0),
        ("c", 2, "a", " win ", 50.0, 60.0, 2, 0.0),  # title again
        ("c", 3, "a", "x", 5.0, 15.0, 3, 0.0),  # overlaps 1 in its source
        ("c", 4, "b", "y", 5.0, 15.0, 4, 0.0),
        ("c", 5, "a", None, 80.0, 90.0, None, 9.0),
        ("c", 6, "a", "z", 100.0, 110.0, None, 8.0),  # third of its source
        ("c", 7, "c", "w", 0.0, 99.0, None, 7.0),  # over the budget
    ]
    df = spark.createDataFrame(rows, "k string, id long, source string, title string, start double, end double, rank int, score double")
    got = [(r.id, r.position) for r in selection.diverse_top(df, ["k"], 2, 0.5, 60.0).orderBy("position").collect()]
    assert got == [(1, 0), (5, 1), (4, 2)]


def test_sessionise_ends_matches_at_outcomes_lobbies_and_gaps(spark):
    rows = [("j", 0.0, "elimination"), ("j", 10.0, "elimination"), ("j", 20.0, "elimination"), ("j", 30.0, "win"), ("j", 40.0, "elimination"), ("j", 45.0, "lobby"), ("j", 50.0, "elimination"), ("j", 350.0, "elimination"), ("j", 651.0, "terminal")]
    df = spark.createDataFrame(rows, "job string, t double, kind string")
    got = [(r.start, r.end, r.n, r.outcome, r.confidence) for r in selection.sessionise(df, ["job"]).orderBy("match").collect()]
    # the lone moment at 40 follows a closed match and stays; 651 is more than a gap after 350 and joins the open match
    assert got == [(0.0, 30.0, 4, "win", "high"), (40.0, 40.0, 1, None, "low"), (50.0, 651.0, 3, "terminal", "medium")]


def test_split_long_cuts_at_the_lowest_interior_point(spark):
    arcs = spark.createDataFrame([("j", 0.0, 100.0), ("j", 200.0, 220.0), ("k", 0.0, 500.0)], "job string, start double, end double")
    curve = spark.createDataFrame([("j", float(t), 0.0 if t in (0, 100) else abs(t - 40) + 1.0) for t in range(0, 101, 10)], "job string, t double, value double")
    got = sorted((r.job, r.start, r.end) for r in selection.split_long(arcs, ["job"], curve, 90.0).collect())
    assert got == [("j", 0.0, 40.0), ("j", 40.0, 100.0), ("j", 200.0, 220.0), ("k", 0.0, 500.0)]


def test_cluster_boxes_takes_medians(spark):
    rows = [("j", 0.0, 0.0, 0.0, 10.0, 10.0), ("j", 1.0, 1.0, 0.0, 10.0, 10.0), ("j", 2.0, 2.0, 0.0, 10.0, 10.0), ("j", 3.0, 50.0, 50.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "job string, t double, x double, y double, w double, h double")
    got = [(r.cluster, r.n, r.x, r.w) for r in selection.cluster_boxes(df, ["job"]).orderBy("cluster").collect()]
    assert got == [(1, 3, 1.0, 10.0), (2, 1, 50.0, 5.0)]


def test_empty_tables_give_no_rows(spark):
    df = spark.createDataFrame([], "job string, id long, start double, end double, score double, passes boolean")
    assert selection.suppress(df, ["job"]).count() == 0
    assert selection.sessionise(spark.createDataFrame([], "job string, t double, kind string"), ["job"]).count() == 0
