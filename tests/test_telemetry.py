"""The fold of progress reports: over a table, on a stream with late and repeated reports, and report by report."""

import random
from datetime import datetime, timedelta

import pytest

from streamlens.streaming import live, telemetry

T0 = datetime(2024, 1, 1)
COLUMNS = [c.split()[0] for c in telemetry.STATE.split(", ")]


def reports(seed, jobs=4, most=40):
    draw, rows = random.Random(seed), []
    for j in range(jobs):
        at = 0.0
        for i in range(draw.randint(1, most)):
            at += draw.choice([0.0, 0.5, 2.0])
            maybe = lambda x, p=0.5: x if draw.random() < p else None  # noqa: E731, B023
            rows.append((f"j{j}", i, T0 + timedelta(seconds=at), at, f"p{i // 9}", maybe(draw.random()), "running", maybe(10.0 * at, 0.4), maybe(2.5, 0.3), maybe(float(draw.randint(1, 99)), 0.5), maybe(draw.choice("xy"), 0.4), maybe(draw.choice([0.0, 600.0, 700.0]), 0.2), maybe(30.0, 0.1)))
    return rows


def one_by_one(rows):
    names = [c.split()[0] for c in telemetry.REPORTS.split(", ")]
    out = {}
    for row in sorted(set(rows), key=lambda r: (r[0], r[1])):
        r = dict(zip(names, row, strict=True))
        out[r["job_id"]] = telemetry.fold_one(out.get(r["job_id"]), r)
    return {j: tuple(s[c] for c in COLUMNS[1:]) for j, s in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_fold_over_a_table_equals_the_fold_report_by_report(spark, seed):
    rows = reports(seed)
    df = spark.createDataFrame([*rows, *rows[::3]], telemetry.REPORTS).repartition(3)
    got = {r.job_id: tuple(r)[1:] for r in telemetry.folded(df).collect()}
    assert {j: [pytest.approx(x) if isinstance(x, float) else x for x in v] for j, v in one_by_one(rows).items()} == {j: list(v) for j, v in got.items()}


def test_stream_with_late_and_repeated_reports_equals_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = reports(9, jobs=2, most=30)
    late = sorted(rows, key=lambda r: r[3] + random.Random(r[1]).choice([0, 0, 4]))  # at most 4 seconds behind
    tick = ("tick", 0, T0 + timedelta(seconds=500), 500.0, "p", None, "running", *[None] * 6)
    batches = [late[: len(late) // 2], [*late[len(late) // 2 :], *late[:5]], [tick]]
    for k, part in enumerate(batches):
        spark.createDataFrame(part, telemetry.REPORTS).coalesce(1).write.parquet(str(tmp_path / "log" / f"b{k}"))
    stream = spark.readStream.schema(telemetry.REPORTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    got = {}
    for r in live.run_to_table(telemetry.live_telemetry(stream, "30 seconds"), "telemetry", "update", str(tmp_path / "cp")).collect():
        got[r.job_id] = max(got.get(r.job_id, ()), tuple(r)[1:], key=lambda v: v[0] if v else -1)
    want = one_by_one(rows)
    assert {j: list(v) for j, v in got.items() if j != "tick"} == {j: [pytest.approx(x) if isinstance(x, float) else x for x in v] for j, v in want.items()}


def test_replay_gives_newest_states_then_candidates_in_order(spark):
    e = spark.createDataFrame([("j", 1, "scan"), ("j", 2, "clip"), ("j", 3, "scan"), ("j", 4, "clip"), ("j", 5, "words"), ("j", 6, "clip"), ("k", 7, "other")], "job_id string, id long, kind string")
    got = [(r.place, r.id) for r in telemetry.replayed(e, ["words", "scan"], ["clip"], most=2).orderBy("place").collect()]
    assert got == [(1, 5), (2, 3), (3, 4), (4, 6)]
