"""Candidates as vectors, and stored vectors of other layouts."""

import pytest
from pyspark.sql import functions as F

from streamlens.operators import candidates, editorial, features


def vector(spark, **given):
    kinds = {str: "string", bool: "boolean", int: "int", float: "double"}
    df = candidates.complete(spark.createDataFrame([tuple(given.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in given.items())))
    x = editorial.with_evidence(candidates.with_score(df))
    return dict(zip(features.NAMES, features.candidate_features(x).select("features").first()[0], strict=True))


BASE = {"id": 1, "start": 10.0, "end": 30.0, "peak": 20.0, "peak_value": 2.0, "reaction_auc": 10.0}


def test_named_numbers_of_a_candidate(spark):
    v = vector(spark, **BASE, anchor=25.0, game_label="elimination", voice=0.4, vod_duration=90_000.0, hook=0.5, text_moment_type="story", outcome="match_win", onscreen="You placed #8", verdict="post", routine_only=True)
    assert (v["mean_intensity"], v["duration"], v["game_tier"], v["peak_position"], v["payoff_position"]) == (0.5, 20.0, 0.8, 0.5, 0.75)
    assert (v["voice"], v["vod_duration_norm"], v["hook_score"], v["moment_type_ordinal"], v["visual_routine_only"]) == (0.4, 12.0, 0.5, 0.45, 1.0)
    assert (v["visual_win"], v["visual_outcome_strength"], v["presentation_rank"]) == (0.0, 0.0, 0.0)  # the screen does not confirm the win


def test_what_is_missing_has_a_value_and_unseen_candidates_no_visual_ones(spark):
    v = vector(spark, **BASE, outcome="elimination")
    assert (v["face"], v["active_channel_count"], v["is_win"], v["payoff_position"], v["visual_outcome_strength"], v["content_interest"]) == (0.0, 1.0, 0.0, 0.5, 0.0, 0.0)


def test_stored_layouts(spark):
    whole = {n: float(i) for i, n in enumerate(features.NAMES)}
    rows = [(1, 8, whole), (2, 7, {**whole, "old": 1.0}), (3, 6, whole), (4, 8, {n: v for n, v in whole.items() if n != "content_anchor"}), (5, 8, {n: v for n, v in whole.items() if n != "exclaim_ratio"}), (6, 8, None), (7, None, whole)]
    df = spark.createDataFrame(rows, "id int, version int, f map<string,double>")
    got = {r.id: (r.s, r.p) for r in df.select("id", features.stored_features(F.col("f"), F.col("version")).alias("s"), features.padded_features(F.col("f")).alias("p")).collect()}
    values = list(whole.values())
    assert got[1] == got[2] == (values, values) and got[3] == got[7] == (None, values) and got[5] == got[6] == (None, None)
    assert got[4][0] is None and got[4][1] == [0.0 if n == "content_anchor" else v for n, v in whole.items()]
    assert len(features.NAMES) == 32 == len(set(features.NAMES)) and pytest.approx(values) == got[1][0]
