"""Where a recording's screen shows chat: statistics of a grid's cells over the frames that hold text, and their connected regions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.strings import screen_text

GRID = 16


@dataclass(frozen=True)
class Layout:
    """What makes a cell part of a chat (fixed values): frames that hold text, frames and share of them in which the cell does, how often its text is another, and words."""

    frames: int = 20
    occupied: int = 8
    weak: float = 0.20
    strong: float = 0.45
    churn: float = 0.50
    words: float = 2.0


def cell_statistics(boxes: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """keys, row, col, n (frames in which the cell holds text), churn (how often its texts differ from those of the frame before in which it did), words (a frame), and frames of the recording.

    boxes: keys, t (frame), x1, y1, x2, y2 and text. A box fills every cell that it touches; the screen ends a little (5 %) behind the furthest box. Texts count as screen texts; boxes without text are left out.
    """
    x = boxes.where("text <> '' AND x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    size = x.groupBy(*keys).agg((F.max("x2") * 1.05).alias("w"), (F.max("y2") * 1.05).alias("h"), F.count_distinct("t").alias("frames")).where("w > 0 AND h > 0")
    x = x.join(size, keys)
    at = lambda c, side: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(c) / F.col(side) * grid))).cast("int")
    x = x.withColumns({"c1": at("x1", "w"), "c2": at("x2", "w"), "r1": at("y1", "h"), "r2": at("y2", "h"), "said": screen_text(F.col("text"))}).where("c2 >= c1 AND r2 >= r1")
    x = x.select(*keys, "t", "frames", "said", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row")).select(*keys, "t", "frames", "said", "row", F.explode(F.sequence("c1", "c2")).alias("col"))
    held = x.groupBy(*keys, "row", "col", "t", "frames").agg(F.array_sort(F.collect_set("said")).alias("texts"))
    held = held.withColumn("words", F.aggregate("texts", F.lit(0), lambda s, v: s + F.when(v == "", 0).otherwise(F.size(F.split(v, " ")))))
    w = W.partitionBy(*keys, "row", "col").orderBy("t")
    held = held.withColumn("other", F.coalesce(F.lag("texts").over(w) != F.col("texts"), F.lit(False)))
    return held.groupBy(*keys, "row", "col", "frames").agg(F.count("*").alias("n"), F.count_if("other").alias("churn"), F.avg("words").alias("words"))


def chat_regions(boxes: DataFrame, keys: list[str], rule: Layout = Layout(), grid: int = GRID) -> DataFrame:
    """keys, x, y, w, h (shares of the screen) and cells of each region: cells that change often and hold several words, joined side by side or one above another, with at least one that is
    there much of the time. A recording with too few frames has none."""
    s = cell_statistics(boxes, keys, grid).where(F.col("frames") >= rule.frames)
    presence = F.col("n") / F.col("frames")
    fits = (F.col("n") >= max(2, rule.occupied)) & (presence >= rule.weak) & (F.col("churn") / (F.col("n") - 1) >= rule.churn) & (F.col("words") >= rule.words)
    cells = s.where(fits).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (presence >= rule.strong).alias("strong"))
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "row int, col int, strong boolean, region int"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """Regions numbered by their smallest cell; a group is one recording's grid."""
        label = {(r, c): r * grid + c for r, c in zip(pdf["row"], pdf["col"], strict=True)}
        todo = sorted(label)
        while todo:
            r, c = todo.pop()
            for beside in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if label.get(beside, -1) > label[r, c]:
                    label[beside] = label[r, c]
                    todo.append(beside)
        return pdf.assign(region=[label[r, c] for r, c in zip(pdf["row"], pdf["col"], strict=True)]).astype({"region": "int32"})

    regions = cells.groupBy(*keys).applyInPandas(joined, schema).groupBy(*keys, "region")
    share = lambda a, b: ((F.max(a) - F.min(a) + b) / grid)
    out = regions.agg(F.max("strong").alias("strong"), (F.min("col") / grid).alias("x"), (F.min("row") / grid).alias("y"), share("col", 1).alias("w"), share("row", 1).alias("h"), F.count("*").alias("cells"))
    return out.where("strong").select(*keys, "x", "y", "w", "h", "cells")
