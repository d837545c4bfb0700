"""Folds over one recording's rows: by runs between wide gaps, with the results of one pass over all."""

import random

from streamlens.operators import intervals


def _thin(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] > gap:
            kept.append(t)
    return kept


def _bounded(spans, gap, span):
    out = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] <= gap and max(out[-1][1], e) - out[-1][0] <= span:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _folds_by_run(df):
    """Whether the rows folded together are told apart by run."""
    return "__run" in df._jdf.queryExecution().optimizedPlan().toString().split("collect_list")[0]


def test_thin_and_bounded_merge_fold_by_run(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randint(0, 900)), float(rng.randint(0, 25))) for k in (1, 2, 3) for _ in range(rng.randint(60, 120))]
    df = spark.createDataFrame([(k, s, s + d) for k, s, d in rows], "k int, s double, e double")
    thin = intervals.thin(df, ["k"], "s", 9.0)
    assert sorted((r.k, r.s) for r in thin.collect()) == [(k, t) for k in (1, 2, 3) for t in _thin([s for j, s, _ in rows if j == k], 9.0)]
    merged = intervals.bounded_merge(df, ["k"], "s", "e", 2.0, 40.0)
    assert sorted((r.k, r.s, r.e) for r in merged.collect()) == [(k, *x) for k in (1, 2, 3) for x in _bounded([(s, s + d) for j, s, d in rows if j == k], 2.0, 40.0)]
    assert _folds_by_run(thin) and _folds_by_run(merged)
