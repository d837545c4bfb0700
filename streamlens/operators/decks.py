"""Decks of a recording: floors and recovery, moment groups, their representatives, the ceiling, and rescues into empty stretches.

Relations between candidates are found by bucketed range joins and every rank, floor and swap is a window or an aggregate of a recording. Two steps depend on
what was chosen before and walk their rows in order of place, streaming: moment groups, stretch by stretch with one number held per row of a stretch, and the deck
itself, whose state is the clips chosen so far, a ceiling's worth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.intervals import gap, overlap_of_shorter
from streamlens.operators.intervals import islands, points_in, range_join, thin
from streamlens.shared import written

#: Neighbouring stretches of one recording that go to one partition.
STRETCHES = 256


@dataclass(frozen=True)
class Moment:
    """When two windows show the same moment (fixed values, in seconds)."""

    overlap: float = 0.30
    near_gap: float = 12.0
    near_span: float = 60.0
    span: float = 120.0
    anchors: float = 8.0
    token_gap: float = 45.0
    shared: int = 3
    jaccard: float = 0.45


@dataclass(frozen=True)
class Deck:
    """A deck's policy (fixed values)."""

    ceiling: int = 15
    least_score: float = 0.75
    floor: float = 0.50
    rich_floor: float = 0.55
    rich_events: int = 4
    rich_window: float = 1800.0
    event_gap: float = 8.0
    recovery: int = 2
    rescue_bonus: float = 0.5
    command_share: float = 0.5
    band: int = 15
    gap_times: float = 2.5
    edge: float = 0.20
    rescues: int = 2


def moment_pairs(df: DataFrame, keys: list[str], m: Moment = Moment()) -> DataFrame:
    """Pairs of the same moment: keys, id and place of the later row, earlier (place of the row before it) and by_tokens.

    df: keys, id, place (rank in the recording), start, end, anchor and label (may be null) and tokens (array of hashes). Two windows are the same moment when they overlap or nearly touch and
    are short together, when their anchors are close and their labels do not differ, or when their words are alike and they are near.
    """
    side = lambda p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "place", "start", "end", "anchor", "label", "tokens")])
    j = range_join(side("a"), side("b"), keys, ("a_start", "a_end"), ("b_start", "b_end"), m.span, m.span).where("b_place < a_place")
    spans = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    together = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    apart = gap(*spans)
    near = (together <= m.near_span + 1e-9) & ((overlap_of_shorter(*spans) > m.overlap) | (apart <= m.near_gap))
    unnamed = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    anchored = (unnamed("a_label") | unnamed("b_label") | (F.col("a_label") == F.col("b_label"))) & (F.abs(F.col("a_anchor") - F.col("b_anchor")) <= m.anchors)
    none = F.array().cast("array<string>")
    words = [F.coalesce(c, none) for c in ("a_tokens", "b_tokens")]
    shared, every = F.size(F.array_intersect(*words)), F.size(F.array_union(*words))
    alike = (apart <= m.token_gap) & (together <= m.span) & (shared >= max(1, m.shared)) & (shared >= m.jaccard * every)
    same = (together <= max(m.near_span, m.span)) & (near | F.coalesce(anchored, F.lit(False)) | alike)
    return j.where(same).select(*keys, F.col("a_id").alias("id"), F.col("a_place").alias("place"), F.col("b_place").alias("earlier"), alike.alias("by_tokens"))


def moment_groups(df: DataFrame, keys: list[str], m: Moment = Moment()) -> DataFrame:
    """df with group (the place of the row that opened it) and source: seed, or tokens or temporal by what ties the row to its group.

    In order of place a row joins the first group that holds any row of the same moment. Windows that start more than span apart never are, so a recording is cut where
    starts leave such a gap, and each stretch is walked by itself.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, "id"]), "group long", "source string"])
    tied = moment_pairs(df, keys, m).groupBy(*keys, "id").agg(F.collect_list(F.struct("earlier", "by_tokens")).alias("tied"))
    x = islands(df.select(*keys, "id", F.col("place").cast("long").alias("place"), "start"), keys, ["start", "id"], lambda w: F.col("start") - F.lag("start").over(w) > max(m.near_span, m.span), "stretch")
    x = x.join(tied, [*keys, "id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group = None, {}
        for pdf in batches:
            out = []
            for row in pdf[[*keys, "stretch", "id", "place", "tied"]].itertuples(index=False, name=None):
                own, (name, place, ties) = row[:-3], row[-3:]
                if own != now:
                    now, group = own, {}
                ties = [(group[t["earlier"]], t["by_tokens"]) for t in ties] if ties is not None else []
                home = min((g for g, _ in ties), default=place)
                group[place] = home
                out.append((*own[:-1], name, home, "seed" if not ties else "tokens" if any(words for g, words in ties if g == home) else "temporal"))
            yield pd.DataFrame(out, columns=[*keys, "id", "group", "source"])

    walked = x.repartition(*keys, F.floor(F.col("stretch") / STRETCHES)).sortWithinPartitions(*keys, "stretch", "place").mapInPandas(run, schema)
    return df.join(walked, [*keys, "id"])


#: What speaks for a window as its moment's representative, most telling first.
EVIDENCE = ["creator", "visual_win", "landed_event", "face_spike", "strong_startle", "crowd_anchor", "spoken_beat"]


def strength(score: str = "score") -> Column:
    """The order of representatives: direct evidence, then the score, then the earlier start."""
    return F.struct(*[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in EVIDENCE], F.col(score).alias("score"), (-F.col("start")).alias("early"))


def representatives(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of moment_groups with the window of most evidence at the place of its group's first one, and that one at its place.

    A viewer's request within a group goes over to the representative: it is protected, and the group's other windows are no longer, unless the creator marked them.
    df: keys, id, place, group, start, score, the EVIDENCE columns, crowd_clip and protected.
    """
    g = W.partitionBy(*keys, "group")
    best = F.max(F.struct(strength().alias("s"), (-F.col("place")).alias("p"))).over(g)
    x = df.withColumns({"__best": -best["p"], "__first": F.min("place").over(g), "__crowd": F.max(F.coalesce("crowd_clip", F.lit(0))).over(g), "__n": F.count("*").over(g)})
    chosen, opened = F.col("place") == F.col("__best"), F.col("place") == F.col("__first")
    asked = (F.col("__crowd") > 0) & (F.col("__n") > 1)
    protected = F.when(asked & chosen, F.lit(True)).when(asked & (F.coalesce("crowd_clip", F.lit(0)) > 0) & ~F.col("creator"), F.lit(False)).otherwise(F.col("protected"))
    crowd = F.when(asked & chosen, F.col("__crowd")).otherwise(F.coalesce("crowd_clip", F.lit(0)))
    place = F.when(chosen, F.col("__first")).when(opened, F.col("__best")).otherwise(F.col("place"))
    moved = F.when(F.col("__best") == F.col("__first"), F.col("source")).when(chosen, F.concat("source", F.lit(":representative"))).when(opened, F.concat("source", F.lit(":alternate"))).otherwise(F.col("source"))
    return x.withColumns({"protected": protected, "crowd_clip": crowd, "place": place, "source": moved}).drop("__best", "__first", "__crowd", "__n")


def admitted(df: DataFrame, keys: list[str], keep: Column | None = None, d: Deck = Deck()) -> DataFrame:
    """df with disposition (eligible, gated, adaptive_quality_floor or event_rich_floor), rescued and a score with the rescues' bonus.

    df: keys, id, peak, anchor, score, passes, exempt (whether floors never cut the row), face_rescue, publishable, protected, is_event, profile, the EVIDENCE columns and crowd_clip. keep: the judges' own word on
    a floor, a function of its column given as an expression over floor (true keeps the row). A recording with more rows than its ceiling has a floor at a share of its best
    score (wins that were only seen and requested moments do not raise it), one rich in distinct events another around them; a recording left with too few rows gets back the cut ones of most evidence.
    """
    every = W.partitionBy(*keys)
    over = lambda c: F.coalesce(c, F.lit(False))
    open_ = F.col("disposition") == "eligible"
    x = df.withColumn("disposition", F.when(F.col("passes"), "eligible").otherwise("gated")).withColumn("rescued", F.lit(False))

    def cut(x: DataFrame, where: Column, best: Column, share: float, name: str) -> DataFrame:
        x = x.withColumn("floor", F.greatest(F.lit(d.least_score), F.coalesce(best, F.lit(0.0)) * share))
        stays = over(F.col("exempt")) | over(F.col("protected")) | (F.col("score") >= F.col("floor")) | (over(keep) if keep is not None else F.lit(False))
        hit = open_ & where & ~stays
        rescue = over(F.col("face_rescue"))
        return x.withColumns({"rescued": F.col("rescued") | (hit & rescue), "disposition": F.when(hit & ~rescue, name).otherwise(F.col("disposition"))}).drop("floor")

    plain = open_ & ~over(F.col("visual_win")) & (F.coalesce("crowd_clip", F.lit(0)) == 0)
    best = F.coalesce(F.max(F.when(plain, F.col("score"))).over(every), F.max(F.when(open_, F.col("score"))).over(every))
    x = x.withColumns({"__n": F.count_if(open_).over(every), "__best": best})
    x = cut(x, F.col("__n") > d.ceiling, F.col("__best"), d.floor, "adaptive_quality_floor").drop("__n", "__best")

    marks = thin(x.where(open_ & F.col("is_event") & ~over(F.col("visual_win"))).select(*keys, F.coalesce("anchor", "peak").alias("t")), keys, "t", d.event_gap)
    around = x.select(*keys, "id", (F.col("peak") - d.rich_window / 2).alias("lo"), (F.col("peak") + d.rich_window / 2).alias("hi"))
    near = points_in(marks, around, keys, "t", ("lo", "hi"), 0.0, d.rich_window).groupBy(*keys, "id").agg(F.count("*").alias("__near"))
    whole = marks.groupBy(*keys).agg(F.count("*").alias("__marks"))
    x = x.join(near, [*keys, "id"], "left").join(whole, keys, "left")
    known = F.max(open_ & (F.coalesce("profile", F.lit("generic")) != "generic")).over(every)
    x = x.withColumn("rich", F.coalesce(F.col("__near") >= d.rich_events, F.lit(False)) | (known & F.coalesce(F.col("__marks") >= d.rich_events, F.lit(False)))).drop("__near", "__marks")
    x = x.withColumn("__best", F.max(F.when(open_ & F.col("rich"), F.col("score"))).over(every))
    x = cut(x, F.col("rich"), F.col("__best"), d.rich_floor, "event_rich_floor").drop("__best")

    lost = F.col("disposition").isin("adaptive_quality_floor", "event_rich_floor") & over(F.col("publishable"))
    back = F.row_number().over(W.partitionBy(*keys, lost).orderBy(strength().desc(), "id"))
    x = x.withColumns({"__n": F.count_if(open_).over(every), "__back": F.when(lost, back)})
    x = x.withColumn("disposition", F.when(F.col("__back") <= d.recovery - F.col("__n"), "eligible").otherwise(F.col("disposition"))).drop("__n", "__back")
    return x.withColumn("score", F.col("score") + F.when(open_ & F.col("rescued"), d.rescue_bonus).otherwise(0.0))


def placed(df: DataFrame, keys: list[str], d: Deck = Deck()) -> DataFrame:
    """Eligible rows of admitted with place: protected ones first, then wins with an anchor, then by score. Viewers' requests beyond their share of the ceiling are no longer protected."""
    asked = F.col("protected") & ~F.col("creator")
    limit = -(-d.ceiling * d.command_share // 1)
    x = df.where("disposition = 'eligible'").withColumn("__asked", F.row_number().over(W.partitionBy(*keys, asked).orderBy(F.desc("score"), "id")))
    x = x.withColumn("protected", F.col("protected") & (~asked | (F.col("__asked") <= limit))).drop("__asked")
    anchored = F.coalesce(F.col("anchored_win"), F.lit(False))
    return x.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("protected"), F.desc(anchored), F.desc("score"), "id")))


def dealt(df: DataFrame, keys: list[str], d: Deck = Deck(), m: Moment = Moment()) -> DataFrame:
    """Rows of representatives with disposition and the window they end up with (start, end), in order of place until the deck is full.

    A row that overlaps or nearly touches a chosen one widens it while both stay short together, and goes; one that overlaps more than allowed, or shares a chosen one's words, goes; behind the
    ceiling the first band rows are kept for a second look (clip_ceiling), the rest are cut. One recording's rows stream by; the clips chosen so far are held.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, "id"]), "disposition string", "start double", "end double"])
    columns = ["id", "start", "end", "group", "source", "protected", "barred"]

    def share(a: list, b: list) -> float:
        shorter = min(a[1] - a[0], b[1] - b[0])
        return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / shorter if shorter > 0 else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chosen, behind = None, [], 0

        def finish() -> list[tuple]:
            return [(*now, c[2], c[4], c[0], c[1]) for c in chosen] if now is not None else []

        for pdf in batches:
            out = []
            for row in pdf[[*keys, *columns]].itertuples(index=False, name=None):
                own, (name, a, b, group, source, protected, barred) = row[: len(keys)], row[len(keys) :]
                if own != now:
                    out += finish()
                    now, chosen, behind = own, [], 0
                window = [a, b]
                covered = any(share(window, c) > m.overlap for c in chosen)
                if len(chosen) >= d.ceiling:
                    said = "overlap_suppressed" if covered else "moment_duplicate" if any(group == c[3] for c in chosen) else "clip_ceiling" if behind < d.band else "editorial_overflow_cutoff"
                    behind += 1
                else:
                    fits = lambda c: max(b, c[1]) - min(a, c[0]) <= m.near_span + 1e-9 and (share(window, c) > m.overlap or max(a - c[1], c[0] - b, 0.0) <= m.near_gap)  # noqa: E731, B023
                    near = next((c for c in chosen if fits(c)), None)
                    if near is not None:
                        said = "overlap_suppressed" if share(window, near) > m.overlap else "nearby_moment_merged"
                        near[0], near[1] = min(near[0], a), max(near[1], b)
                    elif covered:
                        said = "overlap_suppressed"
                    elif source == "tokens" and any(group == c[3] for c in chosen):
                        said = "moment_duplicate"
                    elif barred and not protected:
                        said = "event_rich_admission"
                    else:
                        chosen.append([a, b, name, group, "selected_protected" if protected else "selected_primary"])
                        continue
                out.append((*own, name, said, a, b))
            yield pd.DataFrame(out, columns=[*keys, "id", "disposition", "start", "end"])
        yield pd.DataFrame(finish(), columns=[*keys, "id", "disposition", "start", "end"])

    df = written(df, "grouped")
    rows = df.select(*keys, "id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "group", "source", "protected", "barred", "place")
    walked = rows.repartition(*keys).sortWithinPartitions(*keys, "place").mapInPandas(run, schema)
    return df.drop("disposition", "start", "end").join(walked, [*keys, "id"])


def rebalanced(df: DataFrame, keys: list[str], d: Deck = Deck(), bucket: float = 3600.0) -> DataFrame:
    """Dispositions after up to d.rescues swaps in every full deck: the longest gap of at least d.gap_times the mean spacing that holds an eligible row of both judges' consensus, clear of its
    edges, takes the best such row, and the weakest crowded row without protection leaves.

    df: keys, id, place, start, end, disposition (selected... in the deck), consensus, payoff, visual_payoff, score, protected, visual_win and terminal.
    """
    for _ in range(d.rescues):
        df = _rescued(written(df, "deck"), keys, d, bucket)
    return df


def _rescued(df: DataFrame, keys: list[str], d: Deck, bucket: float) -> DataFrame:
    held = F.col("disposition").startswith("selected")
    middle = (F.col("start") + F.col("end")) / 2
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    deck = df.where(held).withColumn("mid", middle)
    in_time, by_middle, whole = W.partitionBy(*keys).orderBy("start", "place"), W.partitionBy(*keys).orderBy("mid", "place"), W.partitionBy(*keys)
    deck = deck.withColumns({
        "n": F.count("*").over(whole), "spacing": (F.max_by("mid", F.struct("start", "place")).over(whole) - F.min_by("mid", F.struct("start", "place")).over(whole)) / F.greatest(F.lit(1), F.count("*").over(whole) - 1),
        "next": F.lead("start").over(in_time), "lone": F.least(F.col("mid") - F.lag("mid").over(by_middle), F.lead("mid").over(by_middle) - F.col("mid")),
    }).where((F.col("n") >= d.ceiling) & (F.col("n") >= 2) & (F.col("spacing") > 0))
    free = deck.where((F.col("next") - F.col("end") >= d.gap_times * F.col("spacing")) & (F.col("next") > F.col("end")))
    free = free.select(*keys, F.col("end").alias("from"), F.col("next").alias("to"), (F.col("next") - F.col("end")).alias("room"), F.col("start").alias("order"), F.col("place").alias("order2"))
    free = free.withColumns({"lo": F.col("from") + d.edge * F.col("room"), "hi": F.col("to") - d.edge * F.col("room")})
    calls = points_in(df.where(~held & F.coalesce("consensus", F.lit(False))).withColumn("mid", middle), free, keys, "mid", ("lo", "hi"), 0.0, bucket)
    rank = F.struct((-F.col("room")).alias("a"), F.col("order").alias("b"), F.col("order2").alias("c"), (-zero("payoff")).alias("d"), (-zero("visual_payoff")).alias("e"), (-F.least(F.col("mid") - F.col("from"), F.col("to") - F.col("mid"))).alias("f"), (-F.col("score")).alias("g"), F.col("place").alias("h"))
    comes = calls.groupBy(*keys).agg(F.min_by("id", rank).alias("__in"))
    loose = deck.where(~F.col("protected") & ~F.coalesce("visual_win", F.lit(False)) & ~F.coalesce("terminal", F.lit(False)) & (F.col("lone") <= F.col("spacing")))
    goes = loose.groupBy(*keys).agg(F.min_by("id", F.struct(F.coalesce("consensus", F.lit(False)).alias("a"), F.col("score").alias("b"), F.col("lone").alias("c"), F.col("place").alias("d"))).alias("__out"))
    swap = comes.join(goes, keys)
    said = F.when(F.col("id") == F.col("__in"), "selected_temporal_rescue").when(F.col("id") == F.col("__out"), "temporal_blackout_rebalanced").otherwise(F.col("disposition"))
    return df.join(swap, keys, "left").withColumn("disposition", said).drop("__in", "__out")


def deck(df: DataFrame, keys: list[str], keep: Column | None = None, d: Deck = Deck(), m: Moment = Moment(), bucket: float = 3600.0) -> DataFrame:
    """Every candidate of a recording with group, place, disposition and window, from floors to rescues; rank numbers the selected ones in order of time. df: the columns that the steps name."""
    x = written(admitted(written(df, "candidates"), keys, keep, d), "admitted")
    out = x.where("disposition <> 'eligible'").select(*keys, "id", "disposition", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    grouped = representatives(moment_groups(written(placed(x, keys, d), "placed"), keys, m), keys)
    done = rebalanced(dealt(grouped.withColumn("barred", F.col("rich") & ~F.col("is_event") & ~F.col("ordinary")), keys, d, m), keys, d, bucket)
    every = done.select(*keys, "id", "group", "place", "disposition", "start", "end").unionByName(out, allowMissingColumns=True)
    held = F.col("disposition").startswith("selected")
    return every.withColumn("rank", F.when(held, F.row_number().over(W.partitionBy(*keys, held).orderBy("start", "id"))))
