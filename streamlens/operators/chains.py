"""Windows for judges that hold a whole beat: events with what stands next to them, grown by the nearest gap under a longest span."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.operators.intervals import range_join


def grown(start: float, end: float, near: list[tuple[float, float, int]], gap: float, span: float) -> tuple[float, float, list[int]]:
    """The window around one event, and the numbers of the windows that it takes up: again and again the nearest within gap whose union stays within span (then the one that keeps the
    start latest back, ends last, comes first)."""
    taken: list[int] = []
    left = {n: (a, b) for a, b, n in near}
    while True:
        fits = [(max(start - b, a - end, 0.0), min(start, a), -b, n) for n, (a, b) in left.items() if max(start - b, a - end) <= gap and max(end, b) - min(start, a) <= span]
        if not fits:
            return start, end, taken
        _, start, back, n = min(fits)
        end = max(end, -back)
        taken.append(n)
        del left[n]


def causal_windows(windows: DataFrame, keys: list[str], gap: float, span: float) -> DataFrame:
    """keys, id, start, end and members: the window each candidate is judged in, and how many candidates share it (null where it is its own).

    windows: keys, id, place (order in the recording), start, end and event. Windows with the same bounds (to a millisecond) are one. A candidate that several events' beats take up goes to that of most
    windows, then of the longest span, then of the first event. Only windows that fit within span of an event meet it, so what a task grows is one event's neighbourhood.
    """
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    whole = windows.where("end > start")
    nodes = whole.groupBy(*keys, F.round("start", 3).alias("__s"), F.round("end", 3).alias("__e")).agg(
        F.min_by("start", "place").alias("start"), F.min_by("end", "place").alias("end"), F.min("place").cast("long").alias("node"), F.max("event").alias("event"), F.count("*").alias("n")
    )
    seeds = nodes.where("event").select(*keys, F.col("node").alias("seed"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("n").alias("s_n"))
    fits = (F.col("end") - F.col("s_start") <= span) & (F.col("s_end") - F.col("start") <= span) & (F.col("node") != F.col("seed"))
    near = range_join(seeds, nodes.drop("__s", "__e", "event"), keys, ("s_start", "s_end"), ("start", "end"), span, span).where(fits)
    around = near.groupBy(*keys, "seed", "s_start", "s_end").agg(F.collect_list(F.struct("start", "end", "node")).alias("near"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "seed long, start double, end double, taken array<long>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*r[: len(keys)], r.seed, *grown(r.s_start, r.s_end, [(x["start"], x["end"], x["node"]) for x in r.near], gap, span)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=[*keys, "seed", "start", "end", "taken"])

    beats = around.select(*keys, "seed", F.col("s_start").cast("double"), F.col("s_end").cast("double"), "near").mapInPandas(run, schema).where(F.size("taken") > 0)
    parts = beats.select(*keys, "seed", "start", "end", F.explode(F.array_append("taken", F.col("seed"))).alias("node")).join(nodes.select(*keys, "node", "n"), [*keys, "node"])
    sums = parts.groupBy(*keys, "seed").agg(F.sum("n").alias("members"), F.count("*").alias("size"))
    best = parts.join(sums, [*keys, "seed"]).groupBy(*keys, "node").agg(F.max_by(F.struct("start", "end", "members"), F.struct("size", (F.col("end") - F.col("start")).alias("span"), (-F.col("seed")).alias("first"))).alias("__b"))
    named = nodes.select(*keys, "__s", "__e", "node").join(best, [*keys, "node"]).drop("node")
    x = windows.withColumns({"__s": F.round("start", 3), "__e": F.round("end", 3)}).join(named, [*keys, "__s", "__e"], "left")
    return x.select(*keys, "id", F.coalesce("__b.start", F.col("start").cast("double")).alias("start"), F.coalesce("__b.end", F.col("end").cast("double")).alias("end"), F.col("__b.members").alias("members"))
