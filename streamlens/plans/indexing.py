"""Building and refreshing the library's index: concepts of texts, known terms, and one source's rows by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamlens.functions import strings as st
from streamlens.operators import concepts, indexing, search
from streamlens.plans.base import EVENTS_SQL, Plans, events, spark_columns, sql_columns
from streamlens.plans.retrieval import TOKEN
from streamlens.session import table
from streamlens.shared import fresh_path, written
from streamlens.streaming import telemetry

P = Plans()
_FEATURES = 24
_WORDS = f"regexp_extract_all(lower(text), '{TOKEN.replace(chr(39), chr(39) * 2)}')"


def _bucket(term):
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % _FEATURES


def concept_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = written(search.hashed_rows(d, "doc_id", st.tokens(F.col("text")), _bucket), "rows")
    return written(search.weighted_rows(rows, d.agg(F.count("*").alias("n")), _FEATURES), "weighted")


@P.add(f"""WITH t AS (SELECT doc_id AS id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {_FEATURES} AS feature, 1 + ln(count(*)) AS v FROM t GROUP BY 1, 2), d AS (SELECT feature, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT id, feature, v * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS v FROM c JOIN d USING (feature)), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM x GROUP BY 1), u AS (SELECT id, feature, v / norm AS v FROM x JOIN n USING (id)),
q AS (SELECT feature, v AS q FROM u WHERE id = (SELECT min(id) FROM u)) SELECT id, round(coalesce(sum(v * q), 0), 5)::DOUBLE AS cosine, 1.0::DOUBLE AS kept FROM u LEFT JOIN q USING (feature) GROUP BY id""")
def concept_cosines(spark, sf_dir):
    """With as many concepts as features the basis only turns the vectors: every text's length and its cosine to the first one are those of the weighted terms."""
    rows = concept_rows(spark, sf_dir)
    x = concepts.project(rows, concepts.fit(rows, _FEATURES, rank=_FEATURES))
    first = F.broadcast(x.agg(F.min_by("vector", "id").alias("first")))
    cosine = F.aggregate(F.zip_with("vector", "first", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.join(first, F.lit(True)).select("id", F.round(cosine, 5).alias("cosine"), F.round("kept", 6).alias("kept"))


@P.add(f"""WITH k AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM documents), q AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark), x AS (SELECT id, unnest(range(1, len(w) + 1)) AS pos, w FROM q), t AS (SELECT id, pos, w[pos] AS term FROM x)
SELECT id, count(*)::BIGINT AS n, string_agg(term, ' ' ORDER BY pos) AS terms FROM t WHERE term IN (SELECT term FROM k) GROUP BY id""")
def known_query_terms(spark, sf_dir):
    """What is left of each query when terms that no text has are dropped."""
    known = concepts.vocabulary(table(spark, sf_dir, "documents"), st.tokens(F.col("text")))
    x = concepts.known_terms(table(spark, sf_dir, "benchmark"), "item_id", st.tokens(F.col("text")), known)
    return x.select("id", F.size("terms").cast("long").alias("n"), F.array_join("terms", " ").alias("terms"))


_LINE = "SELECT conv_id, conv_id * 1000 + turn AS id, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE + 6 AS b, text FROM conversations"
_CLIP = "SELECT conv_id, conv_id * 1000 + turn AS id, turn * 10.0::DOUBLE - 3 AS a, turn * 10.0::DOUBLE + 4 AS b, role AS title, left(text, 12) AS text FROM conversations WHERE role = 'assistant'"


@P.add(f"""WITH l AS ({_LINE}), c AS ({_CLIP}), s AS (SELECT conv_id, id, 'transcript' AS kind, string_agg(text, ' ' ORDER BY a, id) OVER (PARTITION BY conv_id ORDER BY a, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS text FROM l),
w AS (SELECT c.id, string_agg(l.text, ' ' ORDER BY l.a, l.id) AS words FROM c JOIN l ON l.conv_id = c.conv_id AND l.a <= c.b + 8 AND l.b >= c.a - 8 GROUP BY 1),
x AS (SELECT * FROM s UNION ALL SELECT conv_id, id, 'clip', array_to_string(list_filter([title, text, words], lambda v: coalesce(v, '') <> ''), ' ') FROM c LEFT JOIN w USING (id)) SELECT conv_id, id, kind, text, sha256(kind || '|' || text) AS revision FROM x""")
def composed_documents(spark, sf_dir):
    """What the index encodes: lines with their neighbours, clips with what is spoken around them, and a mark of each."""
    c = table(spark, sf_dir, "conversations")
    i, at = F.col("conv_id") * 1000 + F.col("turn"), F.col("turn") * 10.0
    lines = c.select("conv_id", i.alias("id"), at.alias("start"), (at + 6).alias("end"), "text")
    clips = c.where("role = 'assistant'").select("conv_id", i.alias("id"), (at - 3).alias("start"), (at + 4).alias("end"), F.col("role").alias("title"), F.left("text", F.lit(12)).alias("text"))
    return indexing.composed(lines, clips, ["conv_id"]).select("conv_id", "id", "kind", "text", "revision")


_ENTRY = "SELECT coalesce(source, 'none') AS source, ['transcript', 'clip', 'evidence'][1 + doc_id % 3] AS kind, doc_id AS id, length(text) AS n FROM documents"


@P.add(f"""WITH e AS ({_ENTRY}), m AS (SELECT min(source) AS a, max(source) AS b FROM e) SELECT source, kind, id, n::BIGINT AS n FROM e, m WHERE kind = 'evidence' OR source NOT IN (a, b)
UNION ALL SELECT source, kind, id, n + 1000000 FROM e, m WHERE kind <> 'evidence' AND source IN (a, b) AND id % 2 = 0""")
def refreshed_entries(spark, sf_dir):
    """The index after the first and the last source were rebuilt, twice, without their evidence."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("transcript", "clip", "evidence"))), (F.col("doc_id") % 3 + 1).cast("int"))
    e = written(d.select(F.coalesce("source", F.lit("none")).alias("source"), kind.alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")), "entries")
    path = fresh_path(spark, "index")
    indexing.build(e, path, 8)
    two = e.agg(F.array(F.min("source"), F.max("source")).alias("s")).select(F.explode("s").alias("source"), F.lit("2").alias("revision"))
    fresh = e.where("id % 2 = 0").withColumn("n", F.col("n") + 1000000)
    for _ in range(2):
        indexing.refresh(path, fresh, two, ["transcript", "clip"], 8)
    return indexing.entries(spark, path).select("source", "kind", "id", "n")


_REPORT = [("job_id", "CAST(user_id AS STRING)"), ("id", "event_id"), ("at", "s"), ("phase", "CAST(CAST(floor(s / 500000) AS BIGINT) AS STRING)"), ("progress", "CASE WHEN event_id % 3 <> 0 THEN value / 400 END"), ("status", "event_type"), ("scanned", "CASE WHEN event_id % 4 = 0 THEN s / 2 END"), ("speed", "CASE WHEN event_id % 8 = 0 THEN CAST(event_id % 50 AS DOUBLE) / 4 END"),
           ("eta", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) END"), ("scope", "CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END"), ("duration", "CASE WHEN event_id % 7 = 0 THEN value - 10 END"), ("budget", "CASE WHEN event_id % 9 = 0 THEN CAST(event_id % 50 AS DOUBLE) END")]
_SINCE = "PARTITION BY job_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@P.add(f"""WITH r AS (SELECT {sql_columns(_REPORT)} FROM {EVENTS_SQL}), a AS (SELECT *, first_value("at") OVER (PARTITION BY job_id ORDER BY id) AS started, coalesce((phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY job_id ORDER BY id))::INT, 1) AS turn, coalesce(scope, CASE WHEN eta IS NULL THEN '' END) AS said FROM r),
b AS (SELECT *, sum(turn) OVER (PARTITION BY job_id ORDER BY id) AS run FROM a), c AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY job_id, run ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
d AS (SELECT *, sum((coalesce(before, '') <> '' AND said IS NOT NULL AND said <> before)::INT) OVER (PARTITION BY job_id, run ORDER BY id) AS part FROM c),
l AS (SELECT job_id, id, started, "at" AS updated, phase, status, max(progress) OVER u AS progress, last_value(scanned IGNORE NULLS) OVER u AS scanned, last_value(coalesce(speed, round(scanned / greatest(0.001, "at" - started), 2)) IGNORE NULLS) OVER u AS speed, first_value(CASE WHEN duration > 0 THEN duration END IGNORE NULLS) OVER u AS duration,
  last_value(eta IGNORE NULLS) OVER p AS eta, last_value(scope IGNORE NULLS) OVER p AS scope, last_value(budget IGNORE NULLS) OVER p AS budget, last_value(CASE WHEN budget IS NOT NULL THEN "at" END IGNORE NULLS) OVER p AS since, row_number() OVER (PARTITION BY job_id ORDER BY id DESC) AS back
  FROM d WINDOW u AS ({_SINCE}), p AS (PARTITION BY job_id, run, part ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT job_id, id, round(started, 3) AS started, round(updated, 3) AS updated, phase, status, round(progress, 6) AS progress, round(scanned, 3) AS scanned, round(speed, 2) AS speed, round(duration, 4) AS duration, eta, scope, budget, round(since, 3) AS budget_since FROM l WHERE back = 1""")
def live_telemetry(spark, sf_dir):
    """Every job's telemetry after all of its reports (the stream's fold, over the table)."""
    e = events(spark, sf_dir).select(*spark_columns(_REPORT), "ts")
    x = telemetry.folded(e)
    r = lambda c, n: F.round(c, n).alias(c)
    return x.select("job_id", "id", r("started", 3), r("updated", 3), "phase", "status", r("progress", 6), r("scanned", 3), r("speed", 2), r("duration", 4), "eta", "scope", "budget", r("budget_since", 3))


@P.add("""WITH n AS (SELECT user_id AS job_id, event_type AS kind, max(event_id) AS id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS o FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), c AS (SELECT user_id AS job_id, event_type AS kind, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'error')),
x AS (SELECT job_id, kind, id, o, 0 AS i FROM n UNION ALL SELECT job_id, kind, id, 2, id FROM c WHERE r <= 8) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o, i, id)::INT AS place, id, kind FROM x""")
def replayed_events(spark, sf_dir):
    """What a view opened in the middle of a job is given: the newest states, then the newest candidates in order."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return telemetry.replayed(e, ["view", "click"], ["purchase", "error"], 8)


QUERIES, ORACLE = P.queries, P.oracle
