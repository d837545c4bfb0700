"""Word timing, dominant directions, judged beats, screen layouts and what a library learns, each over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamlens.functions.strings import tokens
from streamlens.operators import chains, directions, layout, networks, profiles, speech
from streamlens.plans.base import EVENTS_SQL, Plans, events, spark_columns, sql_columns
from streamlens.plans.retrieval import TOKEN
from streamlens.session import table
from streamlens.shared import written

P = Plans()
_WORD = [("user_id", "user_id"), ("i", "event_id"), ("start", "CAST(floor(s / 1000) AS DOUBLE) / 4"), ("end", "CAST(floor(s / 1000) AS DOUBLE) / 4 + CASE WHEN event_id % 5 < 3 THEN 0.05 ELSE 0.4 END"), ("media", "CASE WHEN user_id % 3 > 0 THEN CAST(648 + user_id % 3 AS DOUBLE) END")]
_RUN = "PARTITION BY user_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@P.add(f"""WITH w AS (SELECT {sql_columns(_WORD)} FROM {EVENTS_SQL}), f AS (SELECT *, "end" - start <= 0.08 AS flat, lead(start) OVER (PARTITION BY user_id ORDER BY i) AS next FROM w), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT *, coalesce((flat <> lag(flat) OVER (PARTITION BY user_id ORDER BY i))::INT, 1) AS fresh FROM f)),
r AS (SELECT *, first_value(start) OVER ({_RUN}) AS a, last_value(next) OVER ({_RUN}) AS b, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER (PARTITION BY user_id, run ORDER BY i) - 1 AS k FROM g),
p AS (SELECT *, coalesce(b, CASE WHEN media > a THEN media END) AS stop, CASE WHEN b > a THEN greatest(0.22, least(0.5, (b - a) / n)) WHEN b IS NULL AND media > a THEN least(0.5, (media - a) / n) ELSE 0.5 END AS pace FROM r)
SELECT user_id, i, round(CASE WHEN flat THEN least(a + k * pace, coalesce(stop, 1e18)) ELSE start END, 4)::DOUBLE AS start, round(CASE WHEN flat THEN least(a + k * pace + pace, coalesce(stop, 1e18)) ELSE "end" END, 4)::DOUBLE AS "end" FROM p""")
def reflowed_words(spark, sf_dir):
    """Collapsed runs of words spread at a reading pace."""
    w = events(spark, sf_dir).select(*spark_columns(_WORD))
    return speech.reflowed(w, ["user_id"], "media").select("user_id", "i", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@P.add("""WITH f AS (SELECT user_id, event_id AS i, event_id // 700 AS frame FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i) AS run, lead(frame) OVER (PARTITION BY user_id ORDER BY i) AS next FROM (SELECT *, coalesce((frame <> lag(frame) OVER (PARTITION BY user_id ORDER BY i))::INT, 1) AS fresh FROM f)),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER (PARTITION BY user_id, run ORDER BY i) - 1 AS k, last_value(next) OVER (PARTITION BY user_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS after FROM g), s AS (SELECT *, (coalesce(after, frame + n) - frame) / n::DOUBLE AS step FROM r)
SELECT user_id, i, CASE WHEN n > 2 AND step > 0 THEN round_even(frame + step * k, 0)::BIGINT ELSE frame END AS frame FROM s""")
def spread_frames(spark, sf_dir):
    """Runs of equal frames spread up to the next one."""
    f = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("i"), F.floor(F.col("event_id") / 700).alias("frame"))
    return speech.spread_ties(f, ["user_id"]).select("user_id", "i", "frame")


_CHUNK = "SELECT user_id, event_id // 400 AS chunk, list((event_id % 400 + CASE WHEN event_id % 7 < 3 THEN (event_id * 37) % 300 - 150 ELSE 0 END)::DOUBLE ORDER BY event_id) AS d FROM events GROUP BY 1, 2"


@P.add(f"""WITH RECURSIVE c AS ({_CHUNK}), k AS (SELECT user_id, chunk, d, 1::BIGINT AS i, [1::BIGINT] AS len, [0::BIGINT] AS back FROM c
 UNION ALL SELECT user_id, chunk, d, i + 1, list_append(len, coalesce(top, 0) + 1), list_append(back, CASE WHEN top IS NULL THEN 0 ELSE list_min(list_filter(ok, lambda j: len[j] = top)) END) FROM (SELECT *, list_max(list_transform(ok, lambda j: len[j])) AS top FROM (SELECT *, list_filter(range(1, i + 1), lambda j: d[j] <= d[i + 1]) AS ok FROM k WHERE i < len(d)))),
f AS (SELECT * FROM k WHERE i = len(d)), t AS (SELECT user_id, chunk, list_position(len, list_max(len))::BIGINT AS pos FROM f UNION ALL SELECT t.user_id, t.chunk, f.back[t.pos] FROM t JOIN f USING (user_id, chunk) WHERE f.back[t.pos] > 0),
m AS (SELECT user_id, chunk, list_sort(list(pos)) AS known FROM t GROUP BY 1, 2), x AS (SELECT c.user_id, c.chunk, d, known, unnest(range(1, len(d) + 1)) AS i FROM c JOIN m USING (user_id, chunk)),
y AS (SELECT *, list_max(list_filter(known, lambda p: p <= i)) AS a, list_min(list_filter(known, lambda p: p >= i)) AS b FROM x)
SELECT user_id, chunk, i, round_even(CASE WHEN a = i THEN d[i] WHEN a IS NULL THEN d[b] WHEN b IS NULL THEN d[a] WHEN b - a <= 3 THEN CASE WHEN i - a <= b - i THEN d[a] ELSE d[b] END ELSE d[a] + (d[b] - d[a]) / (b - a) * (i - a) END, 0)::BIGINT AS frame FROM y""")
def repaired_frames(spark, sf_dir):
    """Frames of a chunk of words that never fall: the longest non-decreasing subsequence stays, the rest is rebuilt from it."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    off = F.when(i % 7 < 3, (i * 37) % 300 - 150).otherwise(0)
    c = e.groupBy("user_id", F.floor(i / 400).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), (i % 400 + off).cast("double").alias("d")))), lambda x: x["d"]).alias("d"))
    x = c.select("user_id", "chunk", F.posexplode(speech.monotone_frames("d")).alias("i", "frame"))
    return x.select("user_id", "chunk", (F.col("i") + 1).cast("long").alias("i"), "frame")


@P.add()
def edited_words(spark, sf_dir):
    """Turns whose words were edited (every third one dropped or put in capitals, one put in front), with the times of what was heard."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    heard = F.transform("w", lambda x, i: F.struct(x.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end")))
    said = F.concat(F.array(F.lit("well")), F.filter(F.transform("w", lambda x, i: F.when(i % 3 != 1, F.when(i % 5 == 2, F.upper(x)).otherwise(x))), lambda x: x.isNotNull()))
    x = c.select("conv_id", "turn", F.posexplode(speech.retimed_words(heard, F.array_join(said, " "))).alias("place", "x"))
    return x.select("conv_id", "turn", "place", "x.word", F.round("x.start", 4).alias("start"), F.round("x.end", 4).alias("end"))


def _round_sql(n: int) -> str:
    return f"""s{n} AS (SELECT u.label, id, v, round(list_dot_product(v, c), 9) AS s FROM u JOIN c{n - 1} c ON c.label = u.label), r{n} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM s{n}),
p{n} AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM r{n} WHERE r <= greatest(1, floor(n * 0.3::DOUBLE + 1e-9))), m{n} AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM p{n} GROUP BY 1, 2) GROUP BY 1), c{n} AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM m{n})"""


@P.add(f"""WITH e AS (SELECT label, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT label, id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM e),
p0 AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM u), m0 AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM p0 GROUP BY 1, 2) GROUP BY 1), c0 AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM m0), {", ".join(_round_sql(n) for n in range(1, 6))},
d AS (SELECT u.label, list_dot_product(v, c) AS s, id % 4 > 0 AS whole FROM u JOIN c5 c ON c.label = u.label), f AS (SELECT label, avg((s < 0.1)::INT) FILTER (whole) AS far, avg((s >= 0.2)::INT) FILTER (whole) AS near, max(s) AS top FROM d GROUP BY 1)
SELECT label, round(c[1], 5)::DOUBLE AS first, round(c[len(c)], 5)::DOUBLE AS last, round(top, 5)::DOUBLE AS top, round(far, 6)::DOUBLE AS far, round(near, 6)::DOUBLE AS near FROM c5 JOIN f USING (label)""")
def dominant_directions(spark, sf_dir):
    """Each label's dominant direction after five trimmed rounds, and the shares of its vectors far from and near to it."""
    e = table(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    c = written(directions.dominant_directions(e, ["label"], "vec_id", "embedding", size), "directions")
    x = e.join(F.broadcast(c), "label").select("label", "vec_id", directions.dot(directions.unit(F.col("embedding")), F.col("centre")).alias("s"))
    f = directions.shares(x, ["label"], F.col("s"), F.col("vec_id") % 4 > 0, 0.1, 0.2).join(x.groupBy("label").agg(F.max("s").alias("top")), "label")
    r = lambda v, n: F.round(v, n)
    return c.join(f, "label").select("label", r(F.get("centre", F.lit(0)), 5).alias("first"), r(F.element_at("centre", -1), 5).alias("last"), r("top", 5).alias("top"), r("far", 6).alias("far"), r("near", 6).alias("near"))


_BEAT = [("user_id", "user_id"), ("id", "event_id"), ("start", "floor(s / 10000) * 10000"), ("end", "floor(s / 10000) * 10000 + 10000 * (1 + event_id % 4)"), ("event", "event_type = 'purchase'")]
_NEXT = "list_sort(list_transform(list_filter(l, lambda x: greatest(a - x.e, x.s - b) <= 20000 AND greatest(b, x.e) - least(a, x.s) <= 150000), lambda x: {'g': greatest(a - x.e, x.s - b, 0), 'm': least(a, x.s), 'k': -x.e, 'o': x.o}))[1]"


@P.add(f"""WITH RECURSIVE w AS (SELECT {sql_columns([(n, f"CAST({e} AS DOUBLE)" if n in ("start", "end") else e) for n, e in _BEAT])} FROM {EVENTS_SQL} WHERE event_type IN ('purchase', 'error')), n AS (SELECT user_id, start AS s, "end" AS e, min(id) AS o, bool_or("event") AS opens, count(*) AS c FROM w GROUP BY 1, 2, 3), l AS (SELECT user_id, list({{'s': s, 'e': e, 'o': o}}) AS l FROM n GROUP BY 1),
k AS (SELECT n.user_id, o AS seed, s AS a, e AS b, list_filter(l, lambda x: x.o <> n.o) AS l, [o] AS taken, 0::BIGINT AS step FROM n JOIN l USING (user_id) WHERE opens
 UNION ALL SELECT user_id, seed, least(a, p.m), greatest(b, -p.k), list_filter(l, lambda x: x.o <> p.o), list_append(taken, p.o), step + 1 FROM (SELECT *, {_NEXT} AS p FROM k) WHERE p IS NOT NULL),
d AS (SELECT user_id, seed, arg_max(a, step) AS a, arg_max(b, step) AS b, arg_max(taken, step) AS taken FROM k GROUP BY 1, 2 HAVING max(step) > 0), m AS (SELECT d.user_id, seed, a, b, len(taken) AS size, unnest(taken) AS o FROM d),
z AS (SELECT m.user_id, seed, sum(c)::BIGINT AS members FROM m JOIN n ON n.user_id = m.user_id AND n.o = m.o GROUP BY 1, 2), v AS (SELECT m.*, members, row_number() OVER (PARTITION BY m.user_id, o ORDER BY size DESC, b - a DESC, seed) AS r FROM m JOIN z USING (user_id, seed)), q AS (SELECT n.user_id, n.s, n.e, v.a, v.b, v.members FROM v JOIN n ON n.user_id = v.user_id AND n.o = v.o WHERE r = 1)
SELECT w.user_id, w.id, coalesce(q.a, w.start)::DOUBLE AS start, coalesce(q.b, w."end")::DOUBLE AS "end", members FROM w LEFT JOIN q ON q.user_id = w.user_id AND q.s = w.start AND q.e = w."end\"""")
def causal_windows(spark, sf_dir):
    """The whole beat around each event as the window of all candidates in it."""
    w = events(spark, sf_dir).where("event_type IN ('purchase', 'error')").select(*spark_columns([(n, f"CAST({e} AS DOUBLE)" if n in ("start", "end") else e) for n, e in _BEAT])).withColumn("place", F.col("id"))
    return chains.causal_windows(w, ["user_id"], 20000.0, 150000.0).select("user_id", "id", "start", "end", "members")


_KIND = "CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'clip_created' WHEN 'signup' THEN 'compilation_add' ELSE event_type END"
_KEYS = ["'game:' || (user_id % 5)", "'kind:' || (event_id % 3)", "'label:' || (event_id % 7)"]
_USED = "sum((event = 'impression')::INT)::DOUBLE AS impressions, round(sum(CASE event WHEN 'open' THEN 0.45 WHEN 'clip_created' THEN 1.0 WHEN 'compilation_add' THEN 0.8 ELSE 0 END), 4)::DOUBLE AS actions, NULL::DOUBLE AS signal, count(*)::BIGINT AS n"


@P.add(f"""WITH i AS (SELECT {_KIND} AS event, 'q' || (event_id % 11) AS query, 's' || (event_id % 50) AS stable, [{", ".join(_KEYS)}] AS keys FROM events WHERE event_id % 11 <> 4),
c AS (SELECT ['game:' || (o_custkey % 5), 'kind:' || o_orderstatus] AS keys, o_orderstatus = 'F' AS kept, o_orderstatus = 'P' AS passed, o_orderkey % 6 = 1 AS maybe, o_orderkey % 8 = 0 AS exported, o_orderkey % 3 AS compiled FROM orders),
d AS (SELECT unnest(keys) AS key, greatest(-1, least(1, CASE WHEN passed THEN -1 WHEN kept THEN 0.7 WHEN maybe THEN 0.15 ELSE 0 END + CASE WHEN compiled > 0 THEN 0.2 ELSE 0 END + CASE WHEN exported THEN 0.3 ELSE 0 END)) AS signal FROM c WHERE kept OR passed OR maybe OR exported OR compiled > 0)
SELECT 'direct' AS part, stable AS key, {_USED} FROM i GROUP BY 2 UNION ALL SELECT 'feature', key, {_USED} FROM (SELECT event, unnest(keys) AS key FROM i) GROUP BY 2 UNION ALL SELECT 'event', event, {_USED} FROM i GROUP BY 2
UNION ALL SELECT 'editorial', key, NULL, NULL, round(sum(signal), 4)::DOUBLE, count(*) FROM d GROUP BY 2""")
def learning_profile(spark, sf_dir):
    """How results, their features and kinds of use count, and what decisions about clips say of their features, without one query's own uses."""
    e = table(spark, sf_dir, "events")
    i = e.select(F.expr(_KIND).alias("event"), F.expr("'q' || (event_id % 11)").alias("query"), F.expr("'s' || (event_id % 50)").alias("stable_key"), F.array(*[F.expr(k) for k in _KEYS]).alias("keys"))
    s = F.col("o_orderstatus")
    c = table(spark, sf_dir, "orders").select(F.array(F.expr("'game:' || (o_custkey % 5)"), F.expr("'kind:' || o_orderstatus")).alias("keys"), (s == "F").alias("kept"), (s == "P").alias("passed"), F.expr("o_orderkey % 6 = 1").alias("maybe"), F.expr("o_orderkey % 8 = 0").alias("exported"), F.expr("o_orderkey % 3").alias("compilations"))
    return profiles.learning_profile(i, c, "q4").select("part", "key", "impressions", F.round("actions", 4).alias("actions"), F.round("signal", 4).alias("signal"), "n")


_BOX = [("user_id", "user_id % 30"), ("t", "event_id // 90"), ("x1", "CAST(CASE WHEN event_id % 4 < 2 THEN 1500 + event_id % 60 ELSE (event_id * 7) % 1700 END AS DOUBLE)"), ("y1", "CAST((event_id * 13) % 900 AS DOUBLE)"), ("text", "event_type || ' number ' || (event_id % 17)")]
_RULE = layout.Layout(frames=20, occupied=4, weak=0.05, strong=0.10, churn=0.5, words=2.0)


@P.add(f"""WITH RECURSIVE b AS (SELECT {sql_columns(_BOX)} FROM events), x AS (SELECT *, x1 + 260 AS x2, y1 + 60 AS y2 FROM b), z AS (SELECT user_id, max(x2) * 1.05::DOUBLE AS w, max(y2) * 1.05::DOUBLE AS h, count(DISTINCT t) AS frames FROM x GROUP BY 1),
p AS (SELECT user_id, t, frames, trim(regexp_replace(regexp_replace(replace(replace(upper(text), '|', 'I'), '!', 'I'), '[^A-Z0-9# ]+', ' ', 'g'), ' +', ' ', 'g')) AS said, least(15, floor(x1 / w * 16))::INT AS c1, least(15, floor(x2 / w * 16))::INT AS c2, least(15, floor(y1 / h * 16))::INT AS r1, least(15, floor(y2 / h * 16))::INT AS r2 FROM x JOIN z USING (user_id)),
q AS (SELECT user_id, t, frames, said, c1, c2, unnest(range(r1, r2 + 1)) AS r FROM p), o AS (SELECT user_id, t, frames, said, r, unnest(range(c1, c2 + 1)) AS c FROM q), g AS (SELECT user_id, r, c, t, frames, list_sort(list(DISTINCT said)) AS texts FROM o GROUP BY ALL),
u AS (SELECT *, list_sum(list_transform(texts, lambda v: len(string_split(v, ' ')))) AS words, coalesce(texts <> lag(texts) OVER (PARTITION BY user_id, r, c ORDER BY t), FALSE) AS other FROM g),
s AS (SELECT user_id, r, c, frames, count(*) AS n, sum(other::INT) AS churn, avg(words) AS words FROM u GROUP BY ALL), k AS (SELECT user_id, r * 16 + c AS cell, r, c, n / frames >= 0.10 AS strong FROM s WHERE frames >= 20 AND n >= 4 AND n / frames >= 0.05 AND churn / (n - 1) >= 0.5 AND words >= 2),
reach AS (SELECT user_id, cell AS a, cell AS b FROM k UNION SELECT reach.user_id, reach.a, y.cell FROM reach JOIN k m ON m.user_id = reach.user_id AND m.cell = reach.b JOIN k y ON y.user_id = m.user_id AND abs(y.r - m.r) + abs(y.c - m.c) = 1),
l AS (SELECT user_id, b AS cell, min(a) AS region FROM reach GROUP BY 1, 2) SELECT user_id, min(c) / 16::DOUBLE AS x, min(r) / 16::DOUBLE AS y, (max(c) - min(c) + 1) / 16::DOUBLE AS w, (max(r) - min(r) + 1) / 16::DOUBLE AS h, count(*)::BIGINT AS cells FROM l JOIN k USING (user_id, cell) GROUP BY user_id, region HAVING bool_or(strong)""")
def layout_regions(spark, sf_dir):
    """Where a screen shows chat: cells whose words change often, joined to regions."""
    b = table(spark, sf_dir, "events").select(*spark_columns([(n, e.replace("event_id // 90", "floor(event_id / 90)")) for n, e in _BOX])).withColumns({"x2": F.col("x1") + 260, "y2": F.col("y1") + 60})
    return layout.chat_regions(b, ["user_id"], _RULE).select("user_id", "x", "y", "w", "h", "cells")


#: Two small networks with weights from a rule, so that both engines can run them.
_WIDE, _UNITS = 6, 4
_NETS = [
    networks.Network(
        [k * 5.0 for k in range(_WIDE)], [4.0 + k for k in range(_WIDE)], [[((u * 7 + k * 3 + n) % 11 - 5) / 8 for k in range(_WIDE)] for u in range(_UNITS)], [(u - 1.5) / 4 for u in range(_UNITS)], [((u * 5 + n) % 7 - 3) / 2 for u in range(_UNITS)], n / 4 - 0.1
    )
    for n in range(2)
]
_CARD = ["value / 8", "CAST(event_id % 30 AS DOUBLE)", "CAST(user_id % 20 AS DOUBLE)", "CAST(event_id % 7 AS DOUBLE) * 3", "CASE WHEN event_id % 13 <> 0 THEN value / 20 END", "CAST(event_id % 40 AS DOUBLE)"]


def _net_sql(m: networks.Network) -> str:
    units = [f"tanh({' + '.join(f'(x[{k + 1}] - {m.mean[k]}::DOUBLE) / {m.scale[k]}::DOUBLE * {m.inner[u][k]}::DOUBLE' for k in range(_WIDE))} + {m.inner_bias[u]}::DOUBLE)" for u in range(_UNITS)]
    return f"greatest(-{networks.LIMIT}, least({networks.LIMIT}, {' + '.join(f'{t} * {m.outer[u]}::DOUBLE' for u, t in enumerate(units))} + {m.outer_bias}::DOUBLE))"


@P.add(f"""WITH c AS (SELECT event_id AS id, [{", ".join(_CARD)}] AS x, event_id % 17 = 0 AS protected FROM events), p AS (SELECT *, CASE WHEN len(list_filter(x, lambda v: v IS NULL)) = 0 THEN 1 / (1 + exp(-(1.2::DOUBLE * ({" + ".join(_net_sql(m) for m in _NETS)}) / 2 - 0.3::DOUBLE))) END AS p FROM c)
SELECT id, round(p, 6)::DOUBLE AS p, CASE WHEN NOT protected AND p < 0.35 THEN 'predictable_pass' END AS reason FROM p""")
def keep_probability(spark, sf_dir):
    """The chance that each second-look card is kept, null where a feature is missing, and which cards are held back."""
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(*[F.expr(x) for x in _CARD]).alias("x"), (F.col("event_id") % 17 == 0).alias("protected"))
    c = c.withColumn("p", networks.keep_probability(_NETS, F.col("x"), 1.2, -0.3))
    return c.select("id", F.round("p", 6).alias("p"), networks.rejected(F.col("p"), F.col("protected"), 0.35).alias("reason"))


@P.add()
def left_out_keeps(spark, sf_dir):
    """Every labelled document's chance of being good, by networks that have not seen its source."""
    words = tokens(F.col("text"))
    stats = F.array(F.log1p(F.size(words)), F.size(F.array_distinct(words)) / F.greatest(F.lit(1), F.size(words)), F.length("text") / F.greatest(F.lit(1), F.size(words)), F.log1p(F.size(F.split("text", "\n"))))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", stats.alias("f")).join(table(spark, sf_dir, "labels"), "doc_id")  # texts don't travel
    x = written(d.select(F.coalesce("source", F.lit("none")).alias("source"), F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"), F.lit(1.0).alias("w"), "f"), "labelled")
    models = networks.train_folds(x, "source", "id", "y", "w", "f", [1, 2], steps=60, hidden=4)
    return networks.left_out_probabilities(x, "source", "id", "f", written(models, "models")).select("id", F.round("p", 6).alias("p"))


QUERIES, ORACLE = P.queries, P.oracle
