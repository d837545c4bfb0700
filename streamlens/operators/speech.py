"""Timing of spoken words: collapsed runs at a reading pace, times that never run backwards, spread ties, and the times of edited words.

Words are rows of a line (keys and i, their order in it); a line is what one decode gives, some hundred words. Rules over neighbours are windows; the two that weigh a whole line
against itself, the longest subsequence and the alignment of two texts, get it as one array.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.operators.intervals import islands

#: A word at most this long has collapsed; the least and the most seconds that a word is shown.
COLLAPSED, SHORTEST, LONGEST = 0.08, 0.22, 0.5


def reflowed(words: DataFrame, keys: list[str], limit: str | None = None) -> DataFrame:
    """words (keys, i, start, end) with runs of collapsed words spread forward evenly to the next word that has a length, at a pace between SHORTEST and LONGEST, and never beyond it; at the end
    of a line at LONGEST each, within the media (column limit, may be null)."""
    w = W.partitionBy(*keys).orderBy("i")
    x = words.withColumn("__flat", F.col("end") - F.col("start") <= COLLAPSED)
    x = islands(x, keys, ["i"], lambda o: F.col("__flat") != F.lag("__flat").over(o), "__run")
    r = W.partitionBy(*keys, "__run")
    first = F.first("start").over(r.orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    x = x.withColumns({"__a": first, "__n": F.count("*").over(r), "__k": F.row_number().over(r.orderBy("i")) - 1, "__next": F.lead("start").over(w)})
    bound = F.last("__next").over(r.orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # the next run's first start; null at the end of the line
    x = x.withColumn("__b", bound)
    media = F.when(F.col("__b").isNull() & (F.col(limit) > F.col("__a")), F.col(limit)) if limit else F.lit(None).cast("double")
    pace = F.when(F.col("__b") > F.col("__a"), F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), (F.col("__b") - F.col("__a")) / F.col("__n"))))
    pace = F.coalesce(pace, F.when(media.isNotNull(), F.least(F.lit(LONGEST), (media - F.col("__a")) / F.col("__n"))), F.lit(LONGEST))
    stop = F.coalesce("__b", media)
    held = lambda t: F.when(stop.isNotNull(), F.least(t, stop)).otherwise(t)
    at = F.col("__a") + F.col("__k") * pace
    x = x.withColumns({"__s": F.when(F.col("__flat"), held(at)).otherwise(F.col("start")), "__e": F.when(F.col("__flat"), held(at + pace)).otherwise(F.col("end"))})
    return x.withColumns({"start": F.col("__s"), "end": F.col("__e")}).select(*words.columns)


def spread_ties(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, i, frame) with runs of more than two equal frames spread evenly up to the next one, or over as many frames as the run has rows at the end of a line."""
    w = W.partitionBy(*keys).orderBy("i")
    x = islands(frames, keys, ["i"], lambda o: F.col("frame") != F.lag("frame").over(o), "__run").withColumn("__next", F.lead("frame").over(w))
    r = W.partitionBy(*keys, "__run")
    n, k = F.count("*").over(r), F.row_number().over(r.orderBy("i")) - 1
    after = F.last("__next").over(r.orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    x = x.withColumns({"__n": n, "__k": k, "__after": F.coalesce(after, F.col("frame") + n)})
    step = (F.col("__after") - F.col("frame")) / F.col("__n")
    moved = F.when((F.col("__n") > 2) & (step > 0), F.bround(F.col("frame") + step * F.col("__k")).cast("long")).otherwise(F.col("frame"))
    return x.withColumn("frame", moved).select(*frames.columns)


def trusted(values: np.ndarray) -> np.ndarray:
    """The longest non-decreasing subsequence as a mask: of equally long ones that whose last element comes first, and before each element the earliest one that can stand there.

    Elements are dealt to piles by the length of the longest subsequence that they end; within a pile values fall with their place, so both the pile and
    the element before are found by bisection. Values that are not numbers are never trusted.
    """
    mask = np.zeros(len(values), bool)
    tops: list[float] = []  # the smallest value of each pile, rising from pile to pile
    piles: list[list[tuple[float, int]]] = []  # (minus value, place): rising
    before = np.full(len(values), -1)
    for place, value in enumerate(values.tolist()):
        if value != value:
            continue
        pile = bisect_left(tops, np.nextafter(value, np.inf))
        if pile == len(piles):
            piles.append([])
            tops.append(value)
        tops[pile] = value
        if pile:
            below = piles[pile - 1]
            before[place] = below[bisect_left(below, (-value, -1))][1]
        piles[pile].append((-value, place))
    at = piles[-1][0][1] if piles else -1
    while at >= 0:
        mask[at] = True
        at = before[at]
    return mask


def monotone(values: np.ndarray) -> np.ndarray:
    """Whole numbers that never fall: trusted values stay, one or two between two of them take the nearer, more are spread evenly, and those at an end take the nearest."""
    mask = trusted(values)
    places = np.arange(len(values))
    if not mask.any():
        return np.zeros(0, np.int64) if not len(values) else np.zeros(len(values), np.int64)
    known = places[mask]
    out = np.interp(places, known, values[mask])
    for a, b in zip(known[:-1], known[1:], strict=True):
        if 1 < b - a <= 3:
            between = places[a + 1 : b]
            out[a + 1 : b] = np.where(between - a <= b - between, values[a], values[b])
        elif b - a > 3:
            out[a + 1 : b] = values[a] + (values[b] - values[a]) / (b - a) * (places[a + 1 : b] - a)
    return np.rint(out).astype(np.int64)


def monotone_frames(frames: Column | str) -> Column:
    """monotone for a column of arrays; a null array stays null, null elements are not trusted (without any number they are 0)."""

    @F.pandas_udf("array<bigint>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else monotone(np.asarray(v, np.float64)) for v in lists], dtype=object)

    return run(frames)


def _edits(old: list[str], new: list[str]) -> list[list]:
    """[same, old from, old to, new from, new to] for stretches of two word lists in order. A stretch without words on one side joins the one before it, at the beginning the one behind."""
    out: list[list] = []
    i = j = 0
    for a, b, n in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks():
        for same, i2, j2 in ((False, a, b), (True, a + n, b + n)):
            if (i, j) == (i2, j2):
                continue
            bare = not same and (i == i2 or j == j2)
            if out and (bare or not all(x < y for x, y in (out[-1][1:3], out[-1][3:5]))):
                out[-1] = [False, out[-1][1], i2, out[-1][3], j2]
            else:
                out.append([same, i, i2, j, j2])
            i, j = i2, j2
    return out


def retime(words: list[dict], text: str | None) -> list[dict]:
    """Edited text with the times of the words it came from: unchanged words (letters' case aside) keep theirs, a changed stretch shares its own time out by length."""
    heard, said = [w for w in words if w["word"] and w["word"].strip()], (text or "").split()
    if not heard or not said:
        return []
    out = []
    for same, i, i2, j, j2 in _edits([w["word"].strip().lower() for w in heard], [x.lower() for x in said]):
        if same:
            out += [{"word": x, "start": w["start"], "end": w["end"]} for x, w in zip(said[j:j2], heard[i:i2], strict=True)]
            continue
        a, b = heard[i]["start"], heard[i2 - 1]["end"]
        share = np.cumsum([0, *(max(1, len(x)) for x in said[j:j2])])
        at = a + max(0.0, b - a) * share / share[-1]
        out += [{"word": x, "start": float(s), "end": float(e)} for x, s, e in zip(said[j:j2], at[:-1], at[1:], strict=True)]
    return out


#: Lines that a task holds as Python objects at once; a batch of Arrow's has many more.
LINES = 128
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())]))


def retimed_words(words: Column | str, text: Column | str) -> Column:
    """retime for columns of word arrays (word, start, end) and edited texts; a null array has no words."""

    @F.arrow_udf("array<struct<word:string,start:double,end:double>>")
    def run(lists: pa.Array, texts: pa.Array) -> pa.Array:
        out = [pa.array([], _WORDS)]
        for k in range(0, len(lists), LINES):
            part = lists.slice(k, LINES)
            heard = [{"word": w, "start": s, "end": e} for w, s, e in zip(*(part.flatten().field(c).to_pylist() for c in ("word", "start", "end")), strict=True)]
            ends = np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            out.append(pa.array([retime(heard[a:b], t) for a, b, t in zip([0, *ends], ends, texts.slice(k, LINES).to_pylist(), strict=False)], _WORDS))
        return pa.concat_arrays(out)

    return run(words, text)
