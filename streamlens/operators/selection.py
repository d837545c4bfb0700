"""Ordered greedy selection per recording: interval suppression, compilations, matches, long arcs, boxes.

Where a greedy rule depends on what was chosen before, rows are first cut into islands that cannot touch each other, so a group is one
stretch of a recording; what counts over a whole recording (a ceiling) is settled between two such passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators.intervals import islands, points_in


#: Neighbouring stretches of one recording that go to one partition.
ISLANDS = 256


def _overlap(a: tuple[float, float], b: tuple[float, float]) -> float:
    shorter = min(a[1] - a[0], b[1] - b[0])
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / shorter if shorter > 0 else 0.0


def suppress(df: DataFrame, keys: list[str], limit: float = 0.30, near_gap: float = 12.0, near_span: float = 60.0, ceiling: int = 15) -> DataFrame:
    """All rows with disposition and rank. df: keys, id, start, end, score and passes.

    In order of score (then id): gated rows are out; a row that covers more than limit of the shorter of itself and a
    chosen one is suppressed; one within near_gap of a chosen one is merged into it while the union stays
    within near_span; beyond the ceiling rows are overflow. Merging widens the chosen row.

    A chosen row never grows beyond the rows within near_gap of it, so stretches further apart are walked each for itself: once without the
    ceiling, to find the place in the recording's order where it is reached, and once with that place known.
    """
    names = [*keys, "id", "start", "end", "score", "passes"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, "id"]), "start double", "end double", "score double", "passes boolean", "island bigint", "place int", "disposition string"])
    x = df.select(*keys, "id", F.col("start").cast("double"), F.col("end").cast("double"), F.col("score").cast("double"), "passes")
    reach = F.max("end").over(W.partitionBy(*keys).orderBy("start", "end", "id").rowsBetween(W.unboundedPreceding, -1))
    x = islands(x, keys, ["start", "end", "id"], reach.isNull() | (F.col("start") - reach > near_gap))
    x = x.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen: list[list[float]] = []
        now = None
        for pdf in batches:
            said = []
            for row in pdf[[*keys, "island", "start", "end", "passes", "place", "last"]].itertuples(index=False, name=None):
                own, (start, end, ok, place, last) = row[:-5], row[-5:]
                if own != now:
                    now, chosen = own, []
                if not ok:
                    said.append("gated")
                elif any(_overlap((start, end), (c[0], c[1])) > limit for c in chosen):
                    said.append("suppressed")
                else:
                    near = next((c for c in chosen if max(start - c[1], c[0] - end) <= near_gap and max(end, c[1]) - min(start, c[0]) <= near_span), None)
                    if near is not None:
                        near[0], near[1] = min(near[0], start), max(near[1], end)
                        said.append("merged")
                    elif place > last:
                        said.append("overflow")
                    else:
                        chosen.append([start, end])
                        said.append("selected")
            yield pdf[[*names, "island", "place"]].assign(disposition=said)

    # rows stream by stretch and place; only the chosen spans of the stretch at hand are held
    walk = lambda rows: rows.repartition(*keys, F.floor(F.col("island") / ISLANDS)).sortWithinPartitions(*keys, "island", "place").mapInPandas(run, schema)
    open_ = walk(x.withColumn("last", F.lit((1 << 31) - 1)))
    nth = F.row_number().over(W.partitionBy(*keys, F.col("disposition") == "selected").orderBy("place"))
    last = open_.withColumn("nth", nth).where((F.col("disposition") == "selected") & (F.col("nth") == ceiling)).select(*keys, F.col("place").alias("last"))
    done = walk(x.join(last, keys, "left").withColumn("last", F.coalesce("last", F.lit((1 << 31) - 1))))
    rank = F.when(F.col("disposition") == "selected", F.row_number().over(W.partitionBy(*keys, F.col("disposition") == "selected").orderBy("place")))
    return done.select(*keys, "id", "start", "end", "score", "disposition", rank.alias("rank"))


def diverse_top(df: DataFrame, keys: list[str], per_source: int, max_overlap: float, seconds: float) -> DataFrame:
    """A compilation per key: in order of rank, score, id take rows under a cap per source and a budget of seconds, skipping
    repeated titles and spans that overlap a taken one of their source; the result is in order of source and time.

    df: keys, id, source, title, start, end, rank (may be null), score. Gives keys, id, position. Rows stream by key in their order; a task holds the rows taken so far of one key, which the budget bounds.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, "id"]), "position int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, titles, used = None, {}, set(), 0.0

        def finish() -> list[tuple]:
            rows = sorted((str(source), a, name) for source, spans in taken.items() for a, _, name in spans)
            return [(*now, name, i) for i, (_, _, name) in enumerate(rows)]

        for pdf in batches:
            out = []
            for row in pdf[[*keys, "id", "source", "title", "start", "end"]].itertuples(index=False, name=None):
                own, (name, source, title, a, b) = row[: len(keys)], row[len(keys) :]
                if own != now:
                    out += finish() if now is not None else []
                    now, taken, titles, used = own, {}, set(), 0.0
                title, same = (title or "").strip().lower(), taken.get(source, [])
                if len(same) >= per_source or (title and title in titles) or used + (b - a) > seconds or any(_overlap((a, b), x[:2]) >= max_overlap for x in same):
                    continue
                taken.setdefault(source, []).append((a, b, name))
                titles.add(title)
                used += b - a
            yield pd.DataFrame(out, columns=[*keys, "id", "position"]).astype({"position": "int32"})
        yield pd.DataFrame(finish() if now is not None else [], columns=[*keys, "id", "position"]).astype({"position": "int32"})

    rows = df.select(*keys, "id", "source", "title", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.coalesce("rank", F.lit(1 << 30)).alias("__r"), (-F.col("score")).alias("__s"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "__r", "__s", "id").mapInPandas(run, schema)


def sessionise(df: DataFrame, keys: list[str], max_gap: float = 300.0, min_moments: int = 2) -> DataFrame:
    """Matches of a recording from moments (keys, t, kind): a match ends with a win or terminal moment, before a lobby moment, or after
    max_gap; matches of fewer moments join the match before them when it is open.

    Gives keys, match, start, end, n, eliminations, outcome and confidence. Where a match begins depends on neighbouring moments only, and whether it
    joins the one before on that one's last moment, so everything is windows over the recording.
    """
    final = F.col("kind").isin("win", "terminal")
    w = W.partitionBy(*keys).orderBy("t", "kind")
    x = df.withColumn("t", F.col("t").cast("double")).withColumn("__lobbies", F.sum((F.col("kind") == "lobby").cast("int")).over(w)).where("kind <> 'lobby'")
    begins = lambda o: F.lag(final).over(o) | (F.col("t") - F.lag("t").over(o) > max_gap) | (F.col("__lobbies") != F.lag("__lobbies").over(o))
    x = islands(x, keys, ["t", "kind"], begins, "__group")
    groups = x.groupBy(*keys, "__group").agg(F.count("*").alias("n"), F.max(final).alias("closed"))
    g = W.partitionBy(*keys).orderBy("__group")
    joins = (F.col("n") < min_moments) & ~F.lag("closed").over(g)
    match = groups.select(*keys, "__group", F.sum(F.when(joins, 0).otherwise(1)).over(g).cast("int").alias("match"))
    m = x.join(match, [*keys, "__group"]).groupBy(*keys, "match").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").cast("int").alias("n"), F.count_if(F.col("kind") == "elimination").cast("int").alias("eliminations"),
        F.min_by(F.when(final, F.col("kind")), F.when(final, F.struct("t", "kind"))).alias("outcome"),
    )
    kills, won = F.col("eliminations"), F.col("outcome") == "win"
    level = F.when(won & (kills == 0), "low").when(won & (kills >= 3), F.when(F.col("end") - F.col("start") > 1500, "medium").otherwise("high")).when(F.col("outcome").isNotNull() | (kills >= 3), "medium").otherwise("low")
    return m.withColumn("confidence", level)


def split_long(df: DataFrame, keys: list[str], curve: DataFrame, max_span: float = 90.0) -> DataFrame:
    """Arcs longer than max_span are cut at the lowest interior point of their curve, again and again.

    df: keys, start, end; curve: keys, t, value. Gives keys, start, end.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "start double", "end double"])

    def cut(a: float, b: float, t: np.ndarray, value: np.ndarray) -> list[tuple[float, float]]:
        todo, out = [(a, b)], []
        while todo:
            a, b = todo.pop()
            lo, hi = np.searchsorted(t, a, side="right"), np.searchsorted(t, b, side="left")
            if b - a <= max_span or hi <= lo:
                out.append((a, b))
            else:
                at = float(t[lo + int(np.argmin(value[lo:hi]))])
                todo += [(a, at), (at, b)]
        return sorted(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []

        def done() -> list[tuple]:
            rows = pd.concat(parts)
            rows = rows[rows["t"].notna()]
            return [(*now[: len(keys)], a, b) for a, b in cut(now[-2], now[-1], rows["t"].to_numpy(), rows["value"].to_numpy())]

        for pdf in batches:
            out = []
            for own, rows in pdf.groupby([*keys, "start", "end"], sort=False):
                if own != now and parts:
                    out += done()
                    parts = []
                now = own
                parts.append(rows[["t", "value"]])
            yield pd.DataFrame(out, columns=[*keys, "start", "end"])
        if parts:
            yield pd.DataFrame(done(), columns=[*keys, "start", "end"])

    # short arcs stay as they are; the others stream by with the curve inside them in order of time, one arc at hand
    arcs = df.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    long_ = arcs.where(F.col("end") - F.col("start") > max_span)
    inner = points_in(curve.select(*keys, F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value")), long_.select(*keys, F.col("start").alias("a"), F.col("end").alias("b")), keys, "t", ("a", "b"), 0.0, 4 * max_span)
    rows = inner.select(*keys, F.col("a").alias("start"), F.col("b").alias("end"), "t", "value").unionByName(long_.select(*keys, "start", "end", F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("value")))
    rows = rows.repartition(*keys, "start").sortWithinPartitions(*keys, "start", "end", "t", "value")
    return arcs.where(F.col("end") - F.col("start") <= max_span).unionByName(rows.mapInPandas(run, schema))


def cluster_boxes(df: DataFrame, keys: list[str], min_iou: float = 0.5) -> DataFrame:
    """Greedy clusters of boxes in order of t: a box joins the first cluster whose first box it meets at min_iou.

    df: keys, t, x, y, w, h. Gives keys, cluster, n and the median box.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "cluster int", "n int", "x double", "y double", "w double", "h double"])

    def iou(a, b) -> float:
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = max(0.0, w) * max(0.0, h)
        union = a[2] * a[3] + b[2] * b[3] - both
        return both / union if union > 0 else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[tuple]] = []
        for box in pdf.sort_values(["t", "x", "y"])[["x", "y", "w", "h"]].itertuples(index=False, name=None):
            home = next((g for g in groups if iou(g[0], box) >= min_iou), None)
            groups.append([box]) if home is None else home.append(box)
        rows = [(*(pdf[k].iloc[0] for k in keys), i + 1, len(g), *pd.DataFrame(g).median().tolist()) for i, g in enumerate(groups)]
        return pd.DataFrame(rows, columns=[*keys, "cluster", "n", "x", "y", "w", "h"])

    return df.groupBy(*keys).applyInPandas(run, schema)
