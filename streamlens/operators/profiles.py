"""What a library learns from how its results are used and its clips judged: weighted counts by result and by feature of the context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an action counts, and what a decision says.
ACTIONS = {"open": 0.45, "clip_created": 1.0, "compilation_add": 0.8}
KEPT, MAYBE, PASSED, COMPILED, EXPORTED = 0.7, 0.15, -1.0, 0.2, 0.3


def _used(event: Column) -> list[Column]:
    weight = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[event]
    shown = event == "impression"
    return [F.sum(shown.cast("double")).alias("impressions"), F.sum(F.when(shown, 0.0).otherwise(F.coalesce(weight, F.lit(0.0)))).alias("actions"), F.count("*").alias("n")]


def decision_signal(kept: Column, passed: Column, maybe: Column, exported: Column, compilations: Column) -> Column:
    """-1 to 1 for a clip with any decision, export or place in a compilation; null for others."""
    f = lambda c: F.coalesce(c, F.lit(False))
    some = f(kept) | f(passed) | f(maybe) | f(exported) | (F.coalesce(compilations, F.lit(0)) > 0)
    said = F.when(f(passed), PASSED).when(f(kept), KEPT).when(f(maybe), MAYBE).otherwise(0.0)
    total = said + F.when(F.coalesce(compilations, F.lit(0)) > 0, COMPILED).otherwise(0.0) + F.when(f(exported), EXPORTED).otherwise(0.0)
    return F.when(some, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))


def learning_profile(interactions: DataFrame, clips: DataFrame, without_query: str = "") -> DataFrame:
    """part, key, impressions, actions, signal and n: direct by result, feature by context key, event by kind of interaction, editorial by context key of judged clips.

    interactions: event, query, stable_key and keys (the context's keys); those of one query can be left out, to score it by the others. clips: keys, kept, passed, maybe, exported and compilations.
    Interactions are summed by result and by key where they are read, so a key that all share is no hot one.
    """
    x = interactions if not without_query else interactions.where(F.coalesce("query", F.lit("")) != without_query)
    none = F.lit(None).cast("double")
    row = lambda part: [F.lit(part).alias("part"), "key", "impressions", "actions"]
    direct = x.groupBy(F.col("stable_key").alias("key")).agg(*_used(F.col("event"))).select(*row("direct"), none.alias("signal"), "n")
    feature = x.select("event", F.explode("keys").alias("key")).groupBy("key").agg(*_used(F.col("event"))).select(*row("feature"), none.alias("signal"), "n")
    event = x.groupBy(F.col("event").alias("key")).agg(*_used(F.col("event"))).select(*row("event"), none.alias("signal"), "n")
    signal = decision_signal(*[F.col(c) for c in ("kept", "passed", "maybe", "exported", "compilations")])
    judged = clips.select("keys", signal.alias("signal")).where("signal IS NOT NULL").select(F.explode("keys").alias("key"), "signal")
    editorial = judged.groupBy("key").agg(F.sum("signal").alias("signal"), F.count("*").alias("n")).select(F.lit("editorial").alias("part"), "key", none.alias("impressions"), none.alias("actions"), "signal", "n")
    return direct.unionByName(feature).unionByName(event).unionByName(editorial)
