"""Scalar functions on made-up inputs: messages, titles, times, boxes, model scores, contexts, and state changed row by row.

Messages are picked from a list by an event's number; state tables are parts and their orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from streamlens.functions import intervals as fi
from streamlens.functions import scoring, structures, times
from streamlens.functions import strings as st
from streamlens.operators import candidates, learning, library
from streamlens.plans.base import EVENTS_SQL, Plans, events, spark_columns, sql_columns
from streamlens.session import table

P = Plans()
MESSAGES = [
    "!clip", "Clip that please", "mods  clip pls", "eclipse of it", "POGGGGGG chat", "TRIPLE kill!", "he got 4 kills", "quadra", "see https://x.io/a?b=1 now", "@bob hi there", "mail a.b@c.de me", "call +49 170 1234567 ok",
    "мир hello wörld", "(quote!) end-", "level 12 of 345", "", "double 3 kills", "clip_it_now", "welcome to the lobby", "be right back soon", "Be  Right\tBack", "7 kills only",
]
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_'']+')"


def _pick(number: str, values: list[str]) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


MESSAGE = [("id", "event_id"), ("text", _pick("event_id", MESSAGES)), ("emotes", "CAST(event_id % 4 AS INT)"), ("hype", "event_id % 3 = 0")]
_M = f"m AS (SELECT {sql_columns(MESSAGE)} FROM events)"
_INTENT = st.CLIP_INTENT


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*spark_columns(MESSAGE))


@P.add(rf"""WITH {_M}, c AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS low, regexp_matches(text, '{_INTENT}') AS intent FROM m),
p AS (SELECT *, CASE WHEN intent THEN 'clip that' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, 'https?://\S+', ' ', 'g'), '[\w.+-]+@[\w-]+\.[\w.-]+', ' ', 'g'), '@\w+', ' ', 'g'), '\+?\d[\d\s().-]{{7,}}\d', ' ', 'g'), '\s+', ' ', 'g')) END AS phrase FROM c)
SELECT id, intent, round(1 + 0.6 * emotes + 0.8 * hype::INT + 0.5 * contains(text, 'GGGG')::INT, 6)::DOUBLE AS weight, CASE WHEN phrase <> '' AND length(phrase) <= 64 THEN phrase END AS phrase,
  list_max(list_transform(regexp_extract_all(text, '\d+'), lambda d: d::INT)) AS largest, greatest(coalesce(TRY_CAST(regexp_extract(lower(text), '\b([2-5])\s*kills?\b', 1) AS INT), 0), CASE WHEN regexp_matches(lower(text), '\btriple\b') THEN 3 ELSE 0 END, CASE WHEN regexp_matches(lower(text), '\bdouble\b') THEN 2 ELSE 0 END, CASE WHEN regexp_matches(lower(text), '\bquadra\b') THEN 4 ELSE 0 END)::INT AS multiple,
  array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: NOT regexp_matches(w, '\p{{Cyrillic}}')), ' ') AS latin, regexp_replace(lower(text), '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS bare, trim(regexp_replace(lower(text), '[_-]+', ' ', 'g')) AS label,
  regexp_matches(text, '\bbe\s+right\s+back\b', 'i') AS away, CASE WHEN regexp_matches(text, '\bbe\s+right\s+back\b', 'i') THEN 'intermission' WHEN regexp_matches(text, '\blobby\b', 'i') AND NOT hype THEN 'lobby' END AS scene, len(list_filter({WORDS.format('text')}, lambda w: starts_with(w, 'clip'))) > 0 AS clipped FROM p""")
def message_features(spark, sf_dir):
    text = F.col("text")
    scene = structures.first_reason((st.contains_phrase(text, "be right back"), "intermission"), (st.contains_phrase(text, "lobby") & ~F.col("hype"), "lobby"))
    return _messages(spark, sf_dir).select(
        "id", st.is_clip_intent(text).alias("intent"), F.round(st.message_weight(text, F.col("emotes"), F.col("hype")), 6).alias("weight"), st.shareable_phrase(text).alias("phrase"), st.largest_number(text).alias("largest"), st.multiple_count(text).alias("multiple"),
        st.latin_only(text).alias("latin"), st.bare_word(text).alias("bare"), st.label_text(text).alias("label"), st.contains_phrase(text, "be right back").alias("away"), scene.alias("scene"), st.starts_any(st.tokens(text), "clip").alias("clipped"),
    )


@P.add(rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS c, lang, source FROM documents), t AS (SELECT *, CASE WHEN length(c) <= 60 THEN c ELSE regexp_extract(c || ' ', '^(.{{0,60}})[ ]', 1) END AS title FROM d)
SELECT doc_id, trim(title) AS title, 'Clip ' || doc_id || ' from ' || coalesce(source, '') || ' (' || coalesce(lang, '') || ')' AS name, substr(sha1(doc_id || '|' || source), 1, 8) || '-' || substr(sha1(doc_id || '|' || source), 9, 4) || '-' || substr(sha1(doc_id || '|' || source), 13, 4) || '-' || substr(sha1(doc_id || '|' || source), 17, 4) || '-' || substr(sha1(doc_id || '|' || source), 21, 12) AS key FROM t""")
def title_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.trim(st.whole_words(F.col("text"), 60)).alias("title"), st.fill_template("Clip {id} from {source} ({lang})", id=F.col("doc_id"), source=F.col("source"), lang=F.col("lang")).alias("name"), st.window_id(F.col("doc_id"), F.col("source")).alias("key"))


_TAGS = [("a", _pick("event_id", ["Win", "Boss", "Chat"])), ("b", _pick("event_id", ["boss", "LOL", "win", "x"])), ("c", _pick("event_id", ["chat", "Rage"]))]


@P.add(f"""WITH t AS (SELECT event_id AS id, {sql_columns(_TAGS)} FROM events) SELECT id, a || CASE WHEN lower(b) <> lower(a) THEN ',' || b ELSE '' END || CASE WHEN lower(c) <> lower(a) AND lower(c) <> lower(b) THEN ',' || c ELSE '' END AS tags,
array_to_string(list_filter(['game:' || lower(a), CASE WHEN id % 3 <> 0 THEN 'kind:' || lower(b) END, 'scene:' || lower(c)], lambda v: v IS NOT NULL), ' ') AS keys, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN b ELSE a END AS shown FROM t""")
def tag_lists(spark, sf_dir):
    """Ordered distinct appends, context keys, and a present-but-empty value that wins."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *spark_columns(_TAGS))
    kind = F.when(F.col("id") % 3 != 0, F.col("b"))
    m = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("gameplay_text"), F.lit(""))).when(F.col("id") % 5 == 1, F.create_map(F.lit("gameplay_text"), F.col("b"))).when(F.col("id") % 5 == 2, F.create_map(F.lit("other"), F.col("b")))
    return t.select("id", F.array_join(st.append_distinct(F.array("a", "b"), F.array("c")), ",").alias("tags"), F.array_join(structures.context_keys(game=F.col("a"), kind=kind, scene=F.col("c")), " ").alias("keys"), structures.named_first(m, "gameplay_text", F.col("a")).alias("shown"))


_DATES = [("id", "event_id"), ("day", _pick("event_id", ["2024-02-29", "2023-02-29", "2024-1-05", "2024-07-31", "soon", ""])), ("stamp", _pick("event_id", ["2024-03-31T01:30:00Z", "2024-07-01T23:30:00+02:00", "2024-07-01 10:00:00", "bad", "2024-01-01T00:15:00-0500"])), ("s", "s")]


@P.add(f"""WITH d AS (SELECT {sql_columns(_DATES)} FROM {EVENTS_SQL}), u AS (SELECT *, CASE stamp WHEN '2024-03-31T01:30:00Z' THEN TIMESTAMP '2024-03-31 01:30:00' WHEN '2024-07-01T23:30:00+02:00' THEN TIMESTAMP '2024-07-01 21:30:00' WHEN '2024-01-01T00:15:00-0500' THEN TIMESTAMP '2024-01-01 05:15:00' END AS utc FROM d)
SELECT id, CASE WHEN regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN strftime(TRY_CAST(day AS DATE), '%Y-%m-%d') END AS day, strftime(utc, '%Y-%m-%d %H:%M') AS utc, strftime(utc - INTERVAL 8 HOUR, '%Y-%m-%d') AS local_day,
printf('%d:%02d:%02d.%02d', round_even(s * 100, 0)::BIGINT // 360000, round_even(s * 100, 0)::BIGINT // 6000 % 60, round_even(s * 100, 0)::BIGINT // 100 % 60, round_even(s * 100, 0)::BIGINT % 100) AS cue FROM u""")
def date_texts(spark, sf_dir):
    d = events(spark, sf_dir).select(*spark_columns(_DATES))
    utc = times.utc_timestamp(F.col("stamp"))
    return d.select("id", F.date_format(times.valid_date(F.col("day")), "yyyy-MM-dd").alias("day"), F.date_format(utc, "yyyy-MM-dd HH:mm").alias("utc"), times.local_date(utc, "Etc/GMT+8").alias("local_day"), times.subtitle_clock(F.col("s")).alias("cue"))


_BOX = [("id", "event_id"), ("x1", "CAST(event_id % 13 AS DOUBLE)"), ("y1", "CAST(event_id % 7 AS DOUBLE)"), ("w1", "CAST(event_id % 11 AS DOUBLE)"), ("h1", "CAST(1 + event_id % 5 AS DOUBLE)"), ("x2", "CAST(event_id % 9 AS DOUBLE)"), ("y2", "CAST(event_id % 4 AS DOUBLE)"), ("w2", "CAST(2 + event_id % 8 AS DOUBLE)"), ("h2", "CAST(event_id % 6 AS DOUBLE)")]


@P.add(f"""WITH b AS (SELECT {sql_columns(_BOX)} FROM events), o AS (SELECT *, greatest(0, least(x1 + w1, x2 + w2) - greatest(x1, x2)) * greatest(0, least(y1 + h1, y2 + h2) - greatest(y1, y2)) AS o FROM b)
SELECT id, round(CASE WHEN w1 * h1 + w2 * h2 - o > 0 THEN o / (w1 * h1 + w2 * h2 - o) ELSE 0 END, 6) AS iou, round(CASE WHEN w1 * h1 > 0 THEN o / (w1 * h1) ELSE 0 END, 6) AS inside FROM o""")
def box_ratios(spark, sf_dir):
    b = table(spark, sf_dir, "events").select(*spark_columns(_BOX))
    one, two = F.array("x1", "y1", "w1", "h1"), F.array("x2", "y2", "w2", "h2")
    return b.select("id", F.round(fi.box_iou(one, two), 6).alias("iou"), F.round(fi.box_containment(one, two), 6).alias("inside"))


_MEAN, _SCALE, _WEIGHT = [40.0, 3.0, 10.0], [25.0, 2.0, 6.0], [0.8, -0.4, 0.25]
_FEATURES = [("id", "event_id"), ("a", "value"), ("b", "CAST(event_id % 7 AS DOUBLE)"), ("c", "CAST(event_id % 21 AS DOUBLE)"), ("rank", "CAST(event_id % 12 AS INT)"), ("judge", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 10 AS DOUBLE) / 10 END")]
_LINEAR = "0.1 + (a - 40) / 25 * 0.8 + (b - 3) / 2 * -0.4 + (c - 10) / 6 * 0.25"


@P.add(f"""WITH f AS (SELECT {sql_columns(_FEATURES)} FROM events), r AS (SELECT *, {_LINEAR} AS raw, 0.68 * a / (a + 1) + 0.2 * (b / 7) + 0.12 * c / (c + 2.5) AS signal FROM f),
p AS (SELECT *, 1 / (1 + exp(-greatest(-30, least(30, raw)))) AS p1, 1 / (1 + exp(-greatest(-30, least(30, 1.7 * raw - 0.3)))) AS p2 FROM r)
SELECT id, round(raw, 6) AS raw, round(p1, 6) AS p1, round(p2, 6) AS p2, round(1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, p1)) / (1 - greatest(1e-6, least(1 - 1e-6, p1)))) + ln(greatest(1e-6, least(1 - 1e-6, p2)) / (1 - greatest(1e-6, least(1 - 1e-6, p2))))) / 2)), 6) AS both,
round(coalesce(0.7 * judge + 0.3 * signal, signal), 6) AS hook, round(2.0 / (1 + rank), 6) AS prior, round(CASE WHEN judge IS NOT NULL THEN (2 * judge + p1) / 3 ELSE p1 END, 6) AS blended, round_even(greatest(0, least(1, (20 * log10(greatest(a / 100, 1e-9)) + 60) / 60)) * 255, 0)::INT AS loud,
round((c - b) / (greatest(a, 1e-6) / 2) / 3, 6) AS pace, round(CASE WHEN a <= 10 THEN 0 WHEN a <= 40 THEN (a - 10) * (1.0 / 30) WHEN a <= 90 THEN 1 + (a - 40) * (-0.5 / 50) ELSE 0.5 END, 6) AS bend,
CASE WHEN NOT coalesce(b > 0, FALSE) THEN 0 WHEN p1 >= 0.6 THEN 1 WHEN p1 < 0.4 THEN 0 ELSE -1 END AS weak, CASE WHEN p1 <= 0.2162 THEN 'hook_floor' WHEN b / 20 <= 0.1375 THEN 'voice_floor' WHEN c / 20 <= 0.4 THEN 'agreement_floor' END AS second_look FROM p""")
def model_scores(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(*spark_columns(_FEATURES))
    model = learning.Linear(_MEAN, _SCALE, _WEIGHT, 0.1)
    x = F.array("a", "b", "c")
    f = f.withColumn("raw", model.score(x)).withColumn("p1", model.probability(x)).withColumn("p2", scoring.platt(F.col("raw"), 1.7, -0.3))
    r = lambda c, n: F.round(c, 6).alias(n)
    return f.select(
        "id", r(F.col("raw"), "raw"), r(F.col("p1"), "p1"), r(F.col("p2"), "p2"), r(learning.ensemble([F.col("p1"), F.col("p2")]), "both"), r(scoring.hook_score(F.col("a"), F.col("b") / 7, F.col("c"), F.col("judge")), "hook"), r(scoring.rank_prior(F.col("rank")), "prior"),
        r(scoring.blend((2.0, F.col("judge")), (1.0, F.col("p1"))), "blended"), scoring.decibel_byte(F.col("a") / 100).alias("loud"), F.round(scoring.words_per_second_change(F.col("b"), F.col("c"), F.col("a")) / 3, 6).alias("pace"), r(scoring.piecewise(F.col("a"), [(10.0, 0.0), (40.0, 1.0), (90.0, 0.5)]), "bend"),
        learning.weak_label(F.col("p1"), F.col("b") > 0, 0.6, 0.4).alias("weak"), candidates.second_look_reason(F.col("p1"), F.col("b") / 20, F.col("c") / 20).alias("second_look"),
    )


@P.add("""WITH v AS (SELECT user_id, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) SELECT user_id, v[floor(0.95 * (n - 1))::INT + 1] AS p95, v[n // 2 + 1] AS upper, v[ceil(0.95 * n)::INT] AS rank95 FROM v""")
def index_quantiles(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return v.select("user_id", structures.index_quantile(F.col("v"), 0.95).alias("p95"), structures.upper_median(F.col("v")).alias("upper"), structures.nearest_rank(F.col("v"), 0.95).alias("rank95"))


@P.add("""WITH j AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'not json' WHEN event_id % 4 = 1 THEN NULL ELSE props END AS t FROM events) SELECT event_id, coalesce(CASE WHEN json_valid(t) THEN json_extract(t, '$.k')::INT END, -1)::INT AS k FROM j""")
def lenient_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 0, "not json").when(F.col("event_id") % 4 != 1, F.col("props"))
    return e.select("event_id", F.coalesce(structures.json_value(text, "k int")["k"], F.lit(-1)).alias("k"))


@P.add("""WITH c AS (SELECT l_suppkey * 30 AS k, max(l_quantity) AS q, arg_max_null(CASE WHEN l_linenumber > 2 THEN l_returnflag END, l_orderkey * 10 + l_linenumber) AS flag FROM lineitem GROUP BY 1)
SELECT coalesce(p_partkey, k) AS k, coalesce(c.flag, p_brand) AS brand, coalesce(p_type, c.flag) AS kind, greatest(p_size::DOUBLE, c.q) AS size FROM part FULL JOIN c ON c.k = p_partkey""")
def merged_state(spark, sf_dir):
    """Upsert with a rule for every column: new wins, old stays, the greater wins. Every thirtieth key has a change, and some changes have no row yet."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("size"))
    flag = F.max_by(F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")), F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 30).alias("k")).agg(flag.alias("brand"), flag.alias("kind"), F.max("l_quantity").alias("size"))
    return library.merge_upsert(base, c, ["k"], {"brand": "new", "kind": "keep", "size": "max"})


@P.add("""WITH c AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS kept, max(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS passed FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS k, coalesce(c.kept, c_nationkey % 2)::INT AS kept, coalesce(c.passed, 0)::INT AS passed FROM customer LEFT JOIN c ON c.k = c_custkey),
i AS (SELECT * FROM p UNION ALL SELECT DISTINCT s_suppkey + 1400, 7, 7 FROM supplier WHERE s_suppkey + 1400 NOT IN (SELECT k FROM p)) SELECT k, kept, passed FROM i WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def state_patches(spark, sf_dir):
    """Flags patched where a change says so, missing rows inserted once, and rows deleted with what they hang on."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.when(F.col("o_orderstatus") == "F", 1)).alias("kept"), F.max(F.when(F.col("o_orderstatus") == "P", 1)).alias("passed"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 2).cast("int").alias("kept"), F.lit(0).alias("passed"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1400).alias("k"), F.lit(7).alias("kept"), F.lit(7).alias("passed"))
    rows = library.insert_missing(library.patch(c, o, ["k"], ["kept", "passed"]), new, ["k"])
    gone = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("k"))
    return library.delete_cascade({"rows": rows, "other": rows}, "k", gone, ["other"])["rows"]


@P.add("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents), k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE digest END AS digest FROM d WHERE doc_id % 5 <> 0)
SELECT doc_id, digest FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id AND k.digest = d.digest)""")
def changed_documents(spark, sf_dir):
    """What an incremental index must encode again: documents whose digest it does not know."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("text", 256)).alias("digest"))
    return library.changed(d, known, "doc_id", F.col("text")).select("doc_id", F.sha2("text", 256).alias("digest"))


@P.add("""WITH e AS (SELECT event_id AS id, user_id % 40 AS job, event_id % 300 AS clip, event_type || (event_id % 60) AS print FROM events), r AS (SELECT event_id AS ref, user_id % 40 AS job, event_id % 450 AS clip, event_type || (event_id % 60) AS print FROM events),
x AS (SELECT job, clip, min(id) AS id FROM e GROUP BY 1, 2), l AS (SELECT job, print, min(id) AS id FROM e GROUP BY 1, 2 HAVING count(*) = 1)
SELECT ref, coalesce(x.id, l.id) AS resolved FROM r LEFT JOIN x ON x.job = r.job AND x.clip = r.clip LEFT JOIN l ON l.job = r.job AND l.print = r.print""")
def resolved_references(spark, sf_dir):
    """Durable references back to entries: by clip, else by a fingerprint that only one entry has."""
    e = table(spark, sf_dir, "events")
    cols = lambda n: [(F.col("user_id") % 40).alias("job"), (F.col("event_id") % n).alias("clip"), F.concat("event_type", (F.col("event_id") % 60).cast("string")).alias("print")]
    entries = e.select(F.col("event_id").alias("id"), *cols(300))
    refs = e.select(F.col("event_id").alias("ref"), *cols(450))
    return library.resolve(refs, entries, ["job", "clip"], ["job", "print"], "id").select("ref", "resolved")


QUERIES, ORACLE = P.queries, P.oracle
