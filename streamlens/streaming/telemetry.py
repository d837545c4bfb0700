"""A job's live telemetry: one fold of its progress reports, over a table and on a stream.

The stream holds reports back until the watermark has passed them, so late ones are folded in their place and repeated ones once; what it then says equals the fold over the table.
State of a job: reports that wait, and one row. A job that reported its end, or nothing for so long, is forgotten by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Reports: at is in seconds; what a report does not know is null.
REPORTS = "job_id string, id bigint, ts timestamp, at double, phase string, progress double, status string, scanned double, speed double, eta double, scope string, duration double, budget double"
FOLDED = "id bigint, started double, updated double, phase string, progress double, status string, scanned double, speed double, eta double, scope string, duration double, budget double, budget_since double"
STATE = f"job_id string, {FOLDED}"
ENDED = ("completed", "failed", "cancelled")


def folded(reports: DataFrame) -> DataFrame:
    """The telemetry of each job after its last report, by windows in order of id; of reports with the same id one counts.

    Progress never falls; position and speed are the last known, the duration the first known above 0. Expected time left, its scope and the time budget are those of the present scope of the
    present phase: a new phase, a new scope, or a report with neither scope nor expectation after a scope, clears them. A position without a speed counts as that position over the time since the start.
    """
    x = reports.dropDuplicates(["job_id", "id"])
    o = W.partitionBy("job_id").orderBy("id")
    upto = o.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("started", F.first("at").over(upto))
    x = x.withColumn("speed", F.coalesce("speed", F.round(F.col("scanned") / F.greatest(F.lit(0.001), F.col("at") - F.col("started")), 2)))
    x = x.withColumn("__phase", F.sum(F.coalesce(~F.col("phase").eqNullSafe(F.lag("phase").over(o)), F.lit(True)).cast("int")).over(o))
    said = F.coalesce("scope", F.when(F.col("eta").isNull(), F.lit("")))  # null: nothing about the scope
    p = W.partitionBy("job_id", "__phase").orderBy("id")
    x = x.withColumn("__said", said).withColumn("__before", F.last("__said", ignorenulls=True).over(p.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("__cleared", (F.coalesce("__before", F.lit("")) != "") & F.col("__said").isNotNull() & (F.col("__said") != F.col("__before")))
    x = x.withColumn("__scope", F.sum(F.col("__cleared").cast("int")).over(p))
    s = W.partitionBy("job_id", "__phase", "__scope").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    known = lambda c, w: F.last(c, ignorenulls=True).over(w)
    x = x.withColumns({
        "progress": F.max("progress").over(upto), "scanned": known("scanned", upto), "speed": known("speed", upto), "duration": F.first(F.when(F.col("duration") > 0, F.col("duration")), ignorenulls=True).over(upto),
        "eta": known("eta", s), "scope": known("scope", s), "budget_since": known(F.when(F.col("budget").isNotNull(), F.col("at")), s), "budget": known("budget", s), "updated": F.col("at"),
    })
    columns = [c.split()[0] for c in STATE.split(", ")]
    best = x.groupBy("job_id").agg(F.max_by(F.struct(*columns[1:]), "id").alias("r"))
    return best.select("job_id", "r.*").select(*columns)


def fold_one(state: dict[str, Any] | None, r: dict[str, Any]) -> dict[str, Any]:
    """The state after one more report, later than those in it."""
    s = dict(state) if state else {"started": r["at"], "progress": None, "phase": None, "scanned": None, "speed": None, "eta": None, "scope": None, "duration": None, "budget": None, "budget_since": None}
    changed = r["scope"] is not None and r["scope"] != s["scope"]
    ended = r["scope"] is None and r["eta"] is None
    if r["phase"] != s["phase"] or (s["scope"] is not None and (changed or ended)):
        s |= {"eta": None, "scope": None, "budget": None, "budget_since": None}
    s |= {k: r[k] for k in ("scanned", "speed", "eta", "scope") if r[k] is not None}
    if r["scanned"] is not None and r["speed"] is None:
        s["speed"] = round(r["scanned"] / max(0.001, r["at"] - s["started"]), 2)
    if r["budget"] is not None:
        s |= {"budget": r["budget"], "budget_since": r["at"]}
    if s["duration"] is None and r["duration"] is not None and r["duration"] > 0:
        s["duration"] = r["duration"]
    if r["progress"] is not None:
        s["progress"] = r["progress"] if s["progress"] is None else max(s["progress"], r["progress"])
    return s | {"id": r["id"], "updated": r["at"], "phase": r["phase"], "status": r["status"]}


_FIELDS = [c.split()[0] for c in FOLDED.split(", ")]
_WAITING = [c.split()[0] for c in REPORTS.split(", ") if not c.startswith(("job_id", "ts "))]


def _none(x: Any) -> Any:
    return None if x is None or (isinstance(x, float) and pd.isna(x)) else x


class Telemetry(StatefulProcessor):
    """Reports wait in a list until the watermark has passed them; a timer folds them, and another forgets the job."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due bigint, id bigint, at double, phase string, progress double, status string, scanned double, speed double, eta double, scope string, duration double, budget double")
        self.now = handle.getValueState("now", FOLDED)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                due = int(r.ts.value // 1_000_000)
                self.waiting.appendValue((due, *(_none(getattr(r, c)) for c in _WAITING)))
                self.handle.registerTimer(due)
        yield pd.DataFrame(columns=["job_id", *_FIELDS])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((w for w in waiting if w[0] <= passed), key=lambda w: w[1])
        state = dict(zip(_FIELDS, self.now.get(), strict=True)) if self.now.exists() else None
        if not due:
            if state is not None and expiredTimerInfo.getExpiryTimeInMs() >= state["updated"] * 1000 + self.idle_ms:
                self.now.clear()
            yield pd.DataFrame(columns=["job_id", *_FIELDS])
            return
        for w in due:
            report = dict(zip(_WAITING, w[1:], strict=True))
            if state is None or report["id"] > state["id"]:
                state = fold_one(state, report)
        left = [w for w in waiting if w[0] > passed]
        if left:
            self.waiting.put([tuple(w) for w in left])
        else:
            self.waiting.clear()
        self.now.update(tuple(state[c] for c in _FIELDS))
        wait = 0 if state["status"] in ENDED else self.idle_ms
        self.handle.registerTimer(int(max(passed, state["updated"] * 1000) + wait) + 1)
        yield pd.DataFrame([(key[0], *(state[c] for c in _FIELDS))], columns=["job_id", *_FIELDS])

    def close(self) -> None:
        pass


def live_telemetry(reports: DataFrame, late: str = "10 seconds", idle_seconds: float = 3600.0) -> DataFrame:
    """A job's telemetry each time the watermark has passed more of its reports (update mode; needs the RocksDB state store)."""
    return reports.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(Telemetry(int(idle_seconds * 1000)), STATE, "Update", "EventTime")


def replayed(events: DataFrame, latest: list[str], every: list[str], most: int = 800) -> DataFrame:
    """What a view opened in the middle of a job is given: the newest event of each kind in latest, then the newest events of the kinds in every (most of them a job), in order.

    events: job_id, id, kind. Gives job_id, place, id and kind.
    """
    newest = events.where(F.col("kind").isin(latest)).groupBy("job_id", "kind").agg(F.max("id").alias("id"))
    order = F.create_map(*[x for i, k in enumerate(latest) for x in (F.lit(k), F.lit(i))])[F.col("kind")]
    own = events.where(F.col("kind").isin(every)).withColumn("__r", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("id")))).where(F.col("__r") <= most)
    x = newest.select("job_id", "id", "kind", order.alias("__o"), F.lit(0).cast("long").alias("__i")).unionByName(own.select("job_id", "id", "kind", F.lit(len(latest)).alias("__o"), F.col("id").cast("long").alias("__i")))
    return x.withColumn("place", F.row_number().over(W.partitionBy("job_id").orderBy("__o", "__i", "id"))).select("job_id", "place", "id", "kind")
