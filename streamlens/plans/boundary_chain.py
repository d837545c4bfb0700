"""The boundary chain over events: purchases stand for windows, all events for frames, with spans of hours instead of seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamlens.operators import boundaries as bd
from streamlens.plans.base import EVENTS_SQL, Plans, events, spark_columns, sql_columns

P = Plans()
H = 10000.0
B = bd.Bounds(*[x if n == "near_quiet" else x * H for n, x in bd.Bounds().__dict__.items()])
FRAME = [("user_id", "user_id"), ("t", "s"), ("rms", "value / 100"), ("cut", "event_id % 3 = 0"), ("score", "value / 80"), ("label", "CASE event_id % 9 WHEN 0 THEN 'elimination' WHEN 1 THEN 'knock' END")]
ARC = [("user_id", "user_id"), ("id", "event_id"), ("start", "s"), ("end", "s + 40000 * (event_id % 5)"), ("peak", "s + 20000 * (event_id % 5)"), ("anchor", "CASE WHEN event_id % 3 > 0 THEN s + 10000 * (event_id % 7) END"),
       ("label", "CASE WHEN event_id % 2 = 0 THEN 'knock' ELSE 'other' END"), ("settle", "CASE WHEN event_id % 5 > 1 THEN s + 10000 * (event_id % 7) + 30000 END"), ("auc", "value")]
_FA = f"f AS (SELECT {sql_columns(FRAME)} FROM {EVENTS_SQL}), w AS (SELECT {sql_columns(ARC)} FROM {EVENTS_SQL} WHERE event_type = 'purchase')"


def _frames(spark, sf_dir):
    return events(spark, sf_dir).select(*spark_columns(FRAME))


def _arcs(spark, sf_dir):
    a = events(spark, sf_dir).where("event_type = 'purchase'").select(*spark_columns(ARC))
    return a.withColumns({c: F.col(c).cast("double") for c in ("end", "peak", "anchor", "settle")})


def _quiet(x: str, name: str, target: str) -> str:
    """A CTE: x with snap, the quiet place or cut near target (null where the target is)."""
    near = f"SELECT x.id, f.t, f.rms, f.cut, {target} AS target, min(f.rms) OVER (PARTITION BY x.id) AS low FROM {x} x JOIN f ON f.user_id = x.user_id AND f.t BETWEEN {target} - {B.reach} AND {target} + {B.reach}"
    return f"""{name}n AS ({near}), {name}b AS (SELECT id, arg_min(t, (rms, t)) AS quiet, arg_min(t, (abs(t - target), t)) FILTER (cut AND rms <= low * {B.near_quiet}::DOUBLE + 1e-9) AS cut FROM {name}n GROUP BY 1),
{name} AS (SELECT x.*, CASE WHEN ({target}) IS NOT NULL THEN coalesce(b.cut, b.quiet, {target}) END AS {name}_at FROM {x} x LEFT JOIN {name}b b ON b.id = x.id)"""


@P.add(f"""WITH {_FA}, e AS (SELECT *, anchor IS NOT NULL AND label = 'knock' AS event FROM w), v AS (SELECT * REPLACE (CASE WHEN event THEN settle END AS settle) FROM e), {_quiet("v", "qa", f"x.start - {B.lead_pad}")}, {_quiet("qa", "qe", f'x."end" + {B.tail_pad}')}, {_quiet("qe", "qs", "x.settle")},
c AS (SELECT *, CASE WHEN settle IS NOT NULL THEN greatest({B.tail}, least({B.event_tail}, settle - anchor)) WHEN event THEN {B.event_tail} ELSE {B.tail} END AS tail, CASE WHEN event THEN {B.event_lead} ELSE {B.lead} END AS lead, CASE WHEN event THEN {B.event_longest} ELSE {B.longest} END AS most FROM qs),
d AS (SELECT *, greatest(0, least(qa_at, peak - {B.lead}, anchor - lead)) AS a, greatest(qe_at, peak + {B.tail}, anchor + tail) AS b0 FROM c), g AS (SELECT *, CASE WHEN settle IS NOT NULL AND b0 > settle THEN greatest(qs_at, anchor + {B.tail}, peak + {B.tail}) ELSE b0 END AS b FROM d),
h AS (SELECT *, b - a < {B.shortest} AS short, b - a > most AS long FROM g), {_quiet("h", "qo", f"CASE WHEN x.short THEN x.a - ({B.shortest} - (x.b - x.a)) END")},
k AS (SELECT *, greatest(0, least(qo_at, b - {B.shortest} + {B.tail_pad})) AS o, greatest(a, b - most) > peak - {B.lead} AS early FROM qo), l AS (SELECT *, CASE WHEN early THEN greatest(0, peak - {B.lead}) ELSE greatest(a, b - most) END AS c0, CASE WHEN early THEN greatest(0, peak - {B.lead}) + most ELSE b END AS e0 FROM k),
m AS (SELECT *, least(c0, CASE WHEN anchor IS NOT NULL THEN greatest(0, anchor - lead) END) AS c1, greatest(e0, anchor + tail) AS e1 FROM l), n AS (SELECT *, CASE WHEN anchor IS NOT NULL AND e1 - c1 > most THEN greatest(0, e1 - most) ELSE c1 END AS c2 FROM m)
SELECT id, round(CASE WHEN short THEN o WHEN long THEN c2 ELSE a END, 3)::DOUBLE AS start, round(CASE WHEN short THEN greatest(b, o + {B.shortest}) WHEN long THEN e1 ELSE b END, 3)::DOUBLE AS "end", short AS padded FROM n""")
def snapped_windows(spark, sf_dir):
    """Arcs as windows: room around them, quiet places and cuts, anchors, settled voices, and length."""
    return bd.snapped_windows(_arcs(spark, sf_dir), _frames(spark, sf_dir), ["user_id"], B, 100000.0)


@P.add(f"""WITH {_FA}, q AS (SELECT user_id, id, anchor FROM w WHERE anchor IS NOT NULL), u AS (SELECT user_id, quantile_cont(score, 0.5) AS m FROM f GROUP BY 1), s AS (SELECT f.user_id, min(m) AS m, quantile_cont(abs(score - m), 0.5) * 1.4826 AS d FROM f JOIN u USING (user_id) GROUP BY 1),
a AS (SELECT q.id, f.t, lag(f.t) OVER (PARTITION BY q.id ORDER BY f.t) AS before FROM q JOIN f ON f.user_id = q.user_id AND f.t BETWEEN greatest(0, anchor - {B.win_back}) AND greatest(0, anchor - {B.tail}) JOIN s ON s.user_id = q.user_id WHERE score >= greatest(0.45, m + 0.35::DOUBLE * d) OR label IN ('elimination', 'knock')),
r AS (SELECT id, t, sum(CASE WHEN t - before <= {B.win_gap} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY t) AS run FROM a), g AS (SELECT id, min(t) AS first, max(t) AS last FROM r GROUP BY id, run), n AS (SELECT id, arg_max(first, last) AS first FROM g GROUP BY 1)
SELECT q.id, round(CASE WHEN first IS NULL THEN greatest(0, anchor - {B.win_lead}) ELSE least(greatest(0, first - 3), greatest(0, anchor - {B.win_least})) END, 3)::DOUBLE AS start FROM q LEFT JOIN n ON n.id = q.id""")
def win_leads(spark, sf_dir):
    """Where the windows of wins begin: with the play nearest to the banner."""
    a = _arcs(spark, sf_dir).where("anchor IS NOT NULL").select("user_id", "id", "anchor")
    return bd.win_leads(a, _frames(spark, sf_dir), ["user_id"], B, 100000.0).select("id", F.round("start", 3).alias("start"))


@P.add(f"""WITH {_FA}, m AS (SELECT user_id, event_id AS marker, s - 150000 AS lo, s + 50000 AS hi FROM {EVENTS_SQL} WHERE event_type = 'signup'), p AS (SELECT m.user_id, marker, arg_min(t, (-score, t)) AS peak FROM m JOIN f ON f.user_id = m.user_id AND t BETWEEN lo AND hi GROUP BY 1, 2),
h AS (SELECT marker, arg_max(w.id, (auc, -w.id)) AS id FROM p JOIN w ON w.user_id = p.user_id AND p.peak BETWEEN w.start AND w."end" GROUP BY 1), r AS (SELECT *, sum((score <= 0.6)::INT) OVER (PARTITION BY user_id ORDER BY t) AS run FROM f), g AS (SELECT user_id, min(t) AS a, max(t) AS b FROM r WHERE score > 0.6 GROUP BY user_id, run)
SELECT p.marker, round(p.peak, 3)::DOUBLE AS peak, h.id, round(coalesce(w.start, g.a, p.peak), 3)::DOUBLE AS start, round(coalesce(w."end", g.b, p.peak), 3)::DOUBLE AS "end" FROM p LEFT JOIN h ON h.marker = p.marker LEFT JOIN w ON w.id = h.id LEFT JOIN g ON g.user_id = p.user_id AND p.peak BETWEEN g.a AND g.b""")
def credited_markers(spark, sf_dir):
    """What each live marker credits: the strongest window around the strongest reaction near it, or that reaction's own stretch."""
    e = events(spark, sf_dir).where("event_type = 'signup'")
    m = e.select("user_id", F.col("event_id").alias("marker"), (F.col("s") - 150000).alias("lo"), (F.col("s") + 50000).alias("hi"))
    x = bd.marked(m, _frames(spark, sf_dir), _arcs(spark, sf_dir), ["user_id"], 0.6, 100000.0)
    return x.select("marker", *[F.round(c, 3).alias(c) if c != "id" else F.col(c) for c in ("peak", "id", "start", "end")])


@P.add(f"""WITH {_FA}, v AS (SELECT * FROM w WHERE label = 'knock' AND anchor IS NOT NULL), j AS (SELECT v.id, v.anchor, f.t, f.rms FROM v JOIN f ON f.user_id = v.user_id AND t BETWEEN v.anchor - 400000 AND v.anchor), m AS (SELECT *, quantile_cont(rms, 0.5) OVER (PARTITION BY id) AS med FROM j),
l AS (SELECT id, t, coalesce(lag(t) OVER (PARTITION BY id ORDER BY t DESC), anchor) - t AS pause FROM m WHERE med > 0 AND rms >= med * 1.2), k AS (SELECT *, max(pause) OVER (PARTITION BY id ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS worst FROM l), o AS (SELECT id, min(t) - 2 AS onset FROM k WHERE worst <= 120000 GROUP BY id),
x AS (SELECT w.*, onset FROM w LEFT JOIN o ON o.id = w.id), {_quiet("x", "qn", "CASE WHEN x.onset < x.start THEN x.onset END")}, n AS (SELECT *, greatest(0, qn_at, "end" - {B.onset_longest}) AS fresh FROM qn) SELECT id, round(CASE WHEN qn_at IS NOT NULL AND fresh < start THEN fresh ELSE start END, 3)::DOUBLE AS start FROM n""")
def reopened_windows(spark, sf_dir):
    """Windows of events opened where the fight before them begins."""
    x = bd.reopened(_arcs(spark, sf_dir), _frames(spark, sf_dir), ["user_id"], B, 400000.0, reach=400000.0, gap=120000.0, factor=1.2, pad=2.0)
    return x.select("id", F.round("start", 3).alias("start"))


QUERIES, ORACLE = P.queries, P.oracle
