"""Search plans over query texts, proofs of compound queries, and a whole hybrid search over documents.

The query texts are put together from phrases by a customer's number; evidence by an event's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.functions.structures import first_reason
from streamlens.operators import planning, search
from streamlens.plans import retrieval
from streamlens.plans.base import EVENTS_SQL, Plans, events, spark_columns, sql_columns
from streamlens.session import table
from streamlens.shared import written

P = Plans()
WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_'']+')"


def _pick(number: str, values: list[str]) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BEGIN = ["clips I kept", "maybe clips", "already exported", "never exported", "marked live", "unreviewed", "best", "", "Clip  I passed", "not reviewed top"]
_MIDDLE = ["last month", "this month", "", "saved clips", "moments", "of fort nite"]
_END = ["crazy snipes", "died to the boss after screaming", "chat went crazy when I won", "funny story with friends", "headshot kill one tap", "aura farming", "wholesome", "maxed it", "victory royale", "jumpscare reaction in horror", "strong reaction then death", "Fortnite fort"]
QUERY = [("id", "c_custkey"), ("text", f"concat_ws(' ', {_pick('c_custkey', _BEGIN)}, {_pick('c_custkey', _MIDDLE + _MIDDLE[:1])}, {_pick('c_custkey', _END + _END[:1])})")]
_QUERIES = f"q AS (SELECT {sql_columns(QUERY)} FROM customer)"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*spark_columns(QUERY))


def _taken_out(column: str, patterns: list[str]) -> str:
    for p in patterns:
        column = f"regexp_replace({column}, '{p}', ' ', 'gi')"
    return column


def _filters_sql() -> str:
    """One CTE per filter, each taking its words out of the text that the one before left."""
    out = ["f0 AS (SELECT id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest, NULL::VARCHAR AS kind, NULL::VARCHAR AS decision, NULL::VARCHAR AS exported, NULL::VARCHAR AS origin, NULL::VARCHAR AS sort, NULL::VARCHAR AS month FROM q)"]
    for i, (pattern, name, value) in enumerate(planning.FILTERS):
        out.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN regexp_matches(rest, '{pattern}', 'i') THEN coalesce({name}, '{value}') ELSE {name} END AS {name}, {_taken_out('rest', [pattern])} AS rest) FROM f{i})" if name != "month" else f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN month IS NULL AND regexp_matches(rest, '{pattern}', 'i') THEN '{value}' ELSE month END AS month, CASE WHEN month IS NULL THEN {_taken_out('rest', [pattern])} ELSE rest END AS rest) FROM f{i})")
    return ", ".join(out)


_GIVEN = {"kind": "moment", "date_from": "2024-02-10"}


@P.add(f"""WITH {_QUERIES}, {_filters_sql()}, p AS (SELECT id, trim(regexp_replace(rest, '\\s+', ' ', 'g')) AS rest, kind, decision, exported, origin, sort,
CASE month WHEN 'last' THEN '2024-02-01' WHEN 'this' THEN '2024-03-01' END AS date_from, CASE month WHEN 'last' THEN '2024-02-29' WHEN 'this' THEN '2024-03-31' END AS date_to FROM f{len(planning.FILTERS)})
SELECT FALSE AS given, * FROM p UNION ALL SELECT TRUE, * REPLACE ('moment' AS kind, '2024-02-10' AS date_from) FROM p""")
def planned_queries(spark, sf_dir):
    """The filters that each query's text holds, alone and beside a kind and a date that were given with it."""
    today, q = F.lit("2024-03-12").cast("date"), _queries(spark, sf_dir)
    x = planning.plan_filters(q, "text", today).withColumn("given", F.lit(False)).unionByName(planning.plan_filters(q, "text", today, _GIVEN).withColumn("given", F.lit(True)))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return x.select("given", "id", "rest", "kind", "decision", "exported", "origin", "sort", day("date_from"), day("date_to"))


_QUOTED = 'the "under the" licensed "license"'


@P.add(f"""WITH t AS (SELECT doc_id AS id, {WORDS.format('lower(text)')} AS w FROM documents) SELECT id, len(w)::INT AS words FROM t
WHERE len(list_filter(w, lambda x: starts_with(x, 'licensed'))) > 0 AND contains(' ' || array_to_string(w, ' ') || ' ', ' under the ') AND contains(' ' || array_to_string(w, ' ') || ' ', ' license ')""")
def quoted_search(spark, sf_dir):
    """Texts with every phrase that a query quotes and a word for each of its other words that carry meaning."""
    groups, phrases = search.asked(_QUOTED, planning.STOP, planning.FAMILIES)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), search.tokens(F.col("text")).alias("w"))
    return d.where(search.matches(F.col("w"), groups, phrases)).select("id", F.size("w").alias("words"))


def _clauses_sql() -> str:
    out, gone = [], "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    for name, patterns in planning.CLAUSES.items():
        out.append(f"CASE WHEN regexp_matches({gone}, '{'|'.join(patterns)}', 'i') THEN '{name}' END")
        gone = _taken_out(gone, patterns)
    words = ", ".join(f"'{w}'" for w in planning.STOP + planning.GENERIC + planning.GLUE)
    residual = f"array_to_string(list_filter({WORDS.format(f'lower({gone})')}, lambda w: w NOT IN ({words})), ' ')"
    return f"c AS (SELECT id, list_filter([{', '.join(out)}, CASE WHEN id % 4 = 0 THEN 'creator_marker' END], lambda v: v IS NOT NULL) AS clauses, {residual} AS residual FROM q)"


@P.add(f"""WITH {_QUERIES}, {_clauses_sql()} SELECT id, CASE WHEN len(clauses) >= 2 THEN array_to_string(clauses, ',') ELSE '' END AS clauses, CASE WHEN len(clauses) >= 2 THEN residual ELSE '' END AS residual FROM c""")
def compound_plans(spark, sf_dir):
    p = planning.plan_clauses(_queries(spark, sf_dir), "text", F.col("id") % 4 == 0)
    return p.select("id", F.array_join("clauses", ",").alias("clauses"), "residual")


def _concepts_sql() -> str:
    out = []
    for triggers, words in planning.CONCEPTS:
        hits = [f"contains(raw, '{t}')" for t in triggers if " " in t] + [f"len(list_filter(w, lambda x: x = '{t}'" + (f" OR starts_with(x, '{t}')" if len(t) >= 4 else "") + ")) > 0" for t in triggers if " " not in t]
        out.append(f"CASE WHEN {' OR '.join(hits)} THEN '{'|'.join(sorted(words))}' END")
    return f"array_to_string(list_filter([{', '.join(out)}], lambda v: v IS NOT NULL), ' & ')"


_FAMILY_SQL = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(v) for v in f)}) THEN '{'|'.join(sorted(f))}'" for f in planning.FAMILIES) + " ELSE x END"
_STOP_SQL = ", ".join(f"'{w}'" for w in planning.STOP)


@P.add(f"""WITH {_QUERIES}, t AS (SELECT id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS raw, {WORDS.format('lower(text)')} AS w FROM q)
SELECT id, {_concepts_sql()} AS concepts, array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ({_STOP_SQL})), lambda x: {_FAMILY_SQL}), ' & ') AS terms FROM t""")
def query_groups(spark, sf_dir):
    """The thesaurus groups and the word families of each query; groups are ANDed, their words ORed."""
    text = lambda g: F.array_join(F.transform(g, lambda x: F.array_join(x, "|")), " & ")
    return _queries(spark, sf_dir).select("id", text(planning.concept_groups(F.col("text"))).alias("concepts"), text(planning.token_groups(F.col("text"))).alias("terms"))


_ALIASES = [("Fortnite", "fort"), ("Fortnite", "fort nite"), ("headshot", "one tap"), ("boss", "big one"), ("friends", "the squad")]
_ALIAS_SQL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@P.add(f"""WITH {_QUERIES}, t AS (SELECT id, {_ALIAS_SQL} AS raw FROM q),
m AS (SELECT *, CASE WHEN regexp_matches(raw, '\\bfort nite\\b', 'i') THEN '\\bfort nite\\b' WHEN regexp_matches(raw, '\\bFortnite\\b', 'i') THEN '\\bFortnite\\b' WHEN regexp_matches(raw, '\\bfort\\b', 'i') THEN '\\bfort\\b' END AS f,
  CASE WHEN regexp_matches(raw, '\\bheadshot\\b', 'i') THEN '\\bheadshot\\b' WHEN regexp_matches(raw, '\\bone tap\\b', 'i') THEN '\\bone tap\\b' END AS h, CASE WHEN regexp_matches(raw, '\\bfriends\\b', 'i') THEN '\\bfriends\\b' END AS p, CASE WHEN regexp_matches(raw, '\\bboss\\b', 'i') THEN '\\bboss\\b' END AS b FROM t)
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, coalesce(f, '^$'), ' ', 'gi'), coalesce(h, '^$'), ' ', 'gi'), coalesce(p, '^$'), ' ', 'gi'), coalesce(b, '^$'), ' ', 'gi'), '\\s+', ' ', 'g')) AS rest,
array_to_string(list_sort(list_filter([CASE WHEN f IS NOT NULL THEN 'Fortnite' END, CASE WHEN h IS NOT NULL THEN 'headshot' END, CASE WHEN p IS NOT NULL THEN 'friends' END, CASE WHEN b IS NOT NULL THEN 'boss' END], lambda v: v IS NOT NULL)), ',') AS families FROM m""")
def alias_families(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "canonical string, alias string")
    x = planning.expand_aliases(_queries(spark, sf_dir), "id", "text", aliases)
    return x.select("id", "rest", F.array_join(F.array_sort("families"), ",").alias("families"))


_REACTIONS = ["strong_startle", "audio_spike", "voice_reaction", "facecam_reaction", "laughter"]
_EVENTS = ["terminal_win", "knocked", "you-died", "shop", "boss_fight", "round won"]
_VISUAL = ["A boss battle", "the winner stands", "menu", "defeat screen", "headshot"]
_OCR = ["GAME OVER", "VICTORY royale", "ELIMINATED", "40 ammo", "Boss Encounter"]
_PACK = [("id", "event_id"), *((n, e) for n, e in [("r1", _pick("event_id", _REACTIONS)), ("r2", _pick("(event_id + event_id // 7)", _REACTIONS)), ("g", _pick("event_id", _EVENTS)), ("v", _pick("event_id", _VISUAL)), ("o", _pick("event_id", _OCR))]), ("chat_messages", "CAST(event_id % 3 AS INT)"), ("chat_emotes", "CAST(event_id % 2 AS INT)"), ("marked", "event_id % 6 = 0")]
_PACK = [(n, e.replace("event_id // 7", "CAST(floor(event_id / 7) AS BIGINT)")) for n, e in _PACK]
_ASKED = {0: ["victory", "creator_reaction"], 1: ["elimination", "chat_excitement"], 2: ["boss", "death"], 3: ["creator_marker", "victory", "chat_excitement"]}


def _proof_sql(clause: str) -> str:
    if clause == "creator_reaction":
        return "CASE WHEN 'strong_startle' IN (r1, r2) THEN 'reaction_signal:Strong startle' WHEN 'audio_spike' IN (r1, r2) AND 'voice_reaction' IN (r1, r2) THEN 'reaction_signal:Voice Reaction + audio spike' WHEN 'audio_spike' IN (r1, r2) AND 'facecam_reaction' IN (r1, r2) THEN 'reaction_signal:Facecam Reaction + audio spike' END"
    if clause == "chat_excitement":
        return "CASE WHEN chat_messages > 0 THEN 'chat_activity:' || chat_messages || ' chat messages' || CASE WHEN chat_emotes > 0 THEN ' + ' || chat_emotes || ' emotes' ELSE '' END END"
    if clause == "creator_marker":
        return "CASE WHEN marked THEN 'creator_marker:Remember marker' END"
    has = lambda c: f"regexp_matches(replace(replace(lower({c}), '_', ' '), '-', ' '), '\\b({'|'.join(planning.PROOFS[clause])})\\b')"
    return f"CASE WHEN {has('g')} THEN 'gameplay_event:' || g WHEN {has('v')} THEN 'visual_description:' || v WHEN {has('o')} THEN 'on_screen_text:' || o END"


def _proved_sql() -> str:
    parts = []
    for k, clauses in _ASKED.items():
        each = [_proof_sql(c) for c in clauses]
        parts.append(f"SELECT id, {k} AS asked, {' || chr(44) || '.join(each)} AS proofs FROM p")
    return f"SELECT id, asked::INT AS asked, proofs FROM ({' UNION ALL '.join(parts)}) WHERE proofs IS NOT NULL"


@P.add(f"WITH p AS (SELECT {sql_columns(_PACK)} FROM events) {_proved_sql()}")
def proved_clauses(spark, sf_dir):
    """For four compound queries, the memories whose evidence proves every clause, and what proves it."""
    e = table(spark, sf_dir, "events").select(*spark_columns(_PACK))
    e = e.select("id", F.array("r1", "r2").alias("reactions"), F.array("g").alias("gameplay_events"), F.array("v").alias("visual_texts"), F.array("o").alias("ocr_phrases"), "chat_messages", "chat_emotes", "marked")
    out = None
    for k, clauses in _ASKED.items():
        said = F.array_join(F.transform("proofs", lambda p: F.concat(p["source"], F.lit(":"), p["detail"])), ",")
        x = planning.proved(e, clauses).select("id", F.lit(k).alias("asked"), said.alias("proofs"))
        out = x if out is None else out.unionByName(x)
    return out


_RANKED = [("id", "event_id"), ("rank", "event_id"), ("video", "CASE WHEN user_id % 9 <> 0 THEN user_id % 9 END"), ("kind", "event_type"), ("job", "user_id"), ("start", "s"), ("end", "s + 100 + event_id % 40")]


@P.add(f"""WITH RECURSIVE r AS (SELECT {sql_columns(_RANKED)} FROM {EVENTS_SQL} ORDER BY rank LIMIT 2000), n AS (SELECT *, row_number() OVER (PARTITION BY video, kind ORDER BY rank) AS i FROM r WHERE video IS NOT NULL),
k AS (SELECT video, kind, i, id, TRUE AS ok, [{{'j': job, 'a': start, 'b': "end"}}] AS kept FROM n WHERE i = 1
 UNION ALL SELECT n.video, n.kind, n.i, n.id, len(list_filter(kept, lambda x: x.j <> n.job AND abs(x.a - n.start) <= 5000 AND abs(x.b - n."end") <= 8000)) = 0,
   CASE WHEN len(list_filter(kept, lambda x: x.j <> n.job AND abs(x.a - n.start) <= 5000 AND abs(x.b - n."end") <= 8000)) = 0 THEN list_append(kept, {{'j': n.job, 'a': n.start, 'b': n."end"}}) ELSE kept END FROM k JOIN n ON n.video = k.video AND n.kind = k.kind AND n.i = k.i + 1)
SELECT id FROM k WHERE ok UNION ALL SELECT id FROM r WHERE video IS NULL""")
def source_copies(spark, sf_dir):
    """The best 2000 results without copies of a moment from another job of the same video."""
    r = events(spark, sf_dir).select(*spark_columns(_RANKED))
    return search.without_copies(r, 2000, 5000.0, 8000.0).select("id")


_CONCEPT = ["crazy", "erst", "lice", "wild"]
_COMPOUND = ([["licensed", "released"]], [["under", "the"]])
#: What each lane weighs in the fusion; the newest match of a concept weighs more than those behind it.
WEIGHTS = {"keyword": 1.40, "keyword_clip": 1.65, "compound": 1.85, "compound_clip": 2.00, "concept": 1.05, "concept_clip": 1.20, "recent": (1.60, 0.60), "recent_clip": (1.70, 0.70), "semantic": 0.55, "semantic_clip": 0.70}
_HYBRID = f"""
{retrieval._ENTRIES.strip()}, {retrieval._BM25.strip()},
cs AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings),
found AS (SELECT id, kind, source_date, len(list_filter({WORDS.format('lower(text)')}, lambda w: {' OR '.join(f"starts_with(w, '{c}')" for c in _CONCEPT)})) AS n,
  len(list_filter({WORDS.format('lower(text)')}, lambda w: starts_with(w, 'licensed') OR starts_with(w, 'released'))) > 0 AND contains(' ' || array_to_string({WORDS.format('lower(text)')}, ' ') || ' ', ' under the ') AS together FROM entries),
ranked AS (
  SELECT id, 'keyword' AS lane, 1.40 AS weight, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 200)
  UNION ALL SELECT id, 'keyword_clip', 1.65, row_number() OVER (ORDER BY score DESC, id) FROM (SELECT bm.id, score FROM bm JOIN entries e ON e.id = bm.id AND e.kind = 'clip' WHERE score > 0 ORDER BY score DESC, bm.id LIMIT 200)
  UNION ALL SELECT id, 'concept', 1.05, row_number() OVER (ORDER BY n DESC, id) FROM (SELECT id, n FROM found WHERE n > 0 ORDER BY n DESC, id LIMIT 200)
  UNION ALL SELECT id, 'concept_clip', 1.20, row_number() OVER (ORDER BY n DESC, id) FROM (SELECT id, n FROM found WHERE n > 0 AND kind = 'clip' ORDER BY n DESC, id LIMIT 200)
  UNION ALL SELECT id, 'compound', 1.85, row_number() OVER (ORDER BY score DESC, id) FROM (SELECT bm.id, score FROM bm JOIN found USING (id) WHERE score > 0 AND together ORDER BY score DESC, bm.id LIMIT 200)
  UNION ALL SELECT id, 'compound_clip', 2.00, row_number() OVER (ORDER BY score DESC, id) FROM (SELECT bm.id, score FROM bm JOIN found USING (id) WHERE score > 0 AND together AND kind = 'clip' ORDER BY score DESC, bm.id LIMIT 200)
  UNION ALL SELECT id, 'recent', CASE WHEN r = 1 THEN 1.60 ELSE 0.60 END, r FROM (SELECT id, row_number() OVER (ORDER BY source_date DESC, n DESC, id) AS r FROM found WHERE n > 0 AND kind = 'transcript') WHERE r <= 200
  UNION ALL SELECT id, 'recent_clip', CASE WHEN r = 1 THEN 1.70 ELSE 0.70 END, r FROM (SELECT id, row_number() OVER (ORDER BY source_date DESC, n DESC, id) AS r FROM found WHERE n > 0 AND kind = 'clip') WHERE r <= 200),
latent AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM cs WHERE score > 0.02 ORDER BY score DESC, id LIMIT 200)),
latent_clip AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM cs WHERE score > 0.02 AND id IN (SELECT id FROM entries WHERE kind = 'clip') ORDER BY score DESC, id LIMIT 200)),
lanes AS (SELECT * FROM ranked UNION ALL SELECT id, 'semantic', 0.55, row_number() OVER (ORDER BY rank) FROM latent WHERE id IN (SELECT id FROM ranked) UNION ALL SELECT id, 'semantic_clip', 0.70, row_number() OVER (ORDER BY rank) FROM latent_clip WHERE id IN (SELECT id FROM ranked)),
fused AS (SELECT id, sum(weight::DOUBLE / (60 + rank)) AS score FROM lanes GROUP BY id),
place AS (SELECT id, kind, source, id // 10 AS start, id // 10 + CASE WHEN kind = 'clip' THEN 2 ELSE 4 END AS stop FROM entries),
bridge AS (SELECT c.id, max(f.score * 1.18 + 0.0025::DOUBLE / (1 + greatest(0, c.start - l.stop, l.start - c.stop))) AS bridge FROM fused f JOIN place l ON l.id = f.id AND l.kind = 'transcript' JOIN place c ON c.kind = 'clip' AND c.source = l.source AND c.start <= l.stop + 3 AND c.stop >= l.start - 3 GROUP BY c.id),
scored AS (SELECT coalesce(f.id, b.id) AS id, greatest(f.score, b.bridge) AS score, coalesce(b.bridge, 0) > coalesce(f.score, 0) AS by_bridge FROM fused f FULL JOIN bridge b ON b.id = f.id),
final AS (SELECT e.id, e.kind, by_bridge, CASE WHEN by_bridge OR e.kind = 'transcript' THEN 'creator_speech' WHEN contains(text, 'Licensed') THEN 'clip_details' WHEN coalesce(exported, 0) = 1 THEN 'on_screen_text' ELSE 'related_meaning' END AS why, score, kept, passed, game, source, source_date FROM scored JOIN entries e ON e.id = scored.id WHERE coalesce(origin, '') <> 'compilation'),
bonus AS (SELECT *, score + CASE why WHEN 'creator_speech' THEN 0.008 WHEN 'clip_details' THEN 0.006 WHEN 'on_screen_text' THEN -0.0015 ELSE 0 END + CASE WHEN kind = 'clip' THEN 0.004 + CASE WHEN coalesce(kept, 0) = 1 THEN 0.006 WHEN coalesce(passed, 0) = 1 THEN -0.003 ELSE 0 END ELSE 0 END AS total FROM final),
judged AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'not_relevant' WHEN id % 13 = 0 THEN 'relevant' END AS verdict FROM bonus)
"""


@P.add(f"""WITH {_HYBRID}, o AS (SELECT id, why, by_bridge, total, game, source, source_date, row_number() OVER (ORDER BY CASE WHEN verdict = 'relevant' THEN 0 ELSE 1 END, round(total, 9) DESC, id) AS place FROM judged WHERE verdict IS NULL OR verdict <> 'not_relevant')
SELECT id, why, by_bridge, round(total, 7) AS score, place::INT AS place, game, source, source_date FROM o WHERE place <= 100""")
def hybrid_search(spark, sf_dir):
    """Ten lanes fused, the latent ones gated by the others, clips raised by what is spoken in them, facets and priors after the fusion, the reviewer's feedback last."""
    entries = retrieval._entries(spark, sf_dir)
    begins = lambda w: reduce(lambda a, b: a | b, [F.startswith(w, F.lit(c)) for c in _CONCEPT])
    together = lambda words, few: search.matches(few, _COMPOUND[0]) & search.matches(words, [], _COMPOUND[1])
    fields = {"text": F.col("text"), "session": F.col("source"), "game": F.col("game")}
    rows = search.counted(
        entries, "id", fields, retrieval.QUERY, "kind", "source", "kept", "passed", "maybe", "exported", "origin", "game", "source_date", F.contains("text", F.lit("Licensed")).alias("licensed"),
        begins=[*_CONCEPT, *_COMPOUND[0][0]], found={"concept": lambda _, few: F.size(F.filter(few, begins)), "together": together},
    )
    e = search.bm25_scores(written(rows, "rows"), [1.0, 3.0, 2.0], len(retrieval.QUERY))  # the only pass over the texts
    e = written(e.drop(*[c for c in e.columns if c.startswith(("tf", "length"))]), "entries")
    clip = F.col("kind") == "clip"
    words, hits = e.where("score > 0").select("id", "kind", "score"), e.where("concept > 0").select("id", "kind", F.col("concept").alias("score"))
    both = e.where("score > 0 AND together").select("id", "kind", "score")
    recent = e.where("concept > 0").select("id", "kind", F.struct("source_date", "concept").alias("score"))
    kinds = [(words, "keyword"), (words.where(clip), "keyword_clip"), (both, "compound"), (both.where(clip), "compound_clip"), (hits, "concept"), (hits.where(clip), "concept_clip"), (recent.where("kind = 'transcript'"), "recent"), (recent.where(clip), "recent_clip")]
    lanes = [written(reduce(DataFrame.unionByName, [search.lane(x, name, 200) for x, name in kinds]), "lanes")]  # at most 1,600 rows
    v = table(spark, sf_dir, "embeddings")
    q, clips = retrieval.query_vector(v), e.where(clip).select(F.col("id").alias("vec_id"))
    latent = [search.gated_lane(search.lane(search.cosine_top(v, "vec_id", "embedding", q, 200, allowed=a), n, 200), lanes) for n, a in (("semantic", None), ("semantic_clip", clips))]
    fused = written(search.fuse([*lanes, *latent], WEIGHTS), "fused")
    place = e.select("id", "kind", "source", F.floor(F.col("id") / 10).alias("a"), (F.floor(F.col("id") / 10) + F.when(clip, 2).otherwise(4)).alias("b"))
    spoken = place.where("kind = 'transcript'").join(fused.select("id"), "id", "left_semi").select("source", F.col("id").alias("line"), F.col("a").alias("la"), F.col("b").alias("lb"))
    near = search_pairs(spoken, place.where(clip).select("source", F.col("id").alias("clip"), "a", "b"))
    x = search.bridged(fused, near).join(e.drop("score"), "id").where(search.result_facets() & (F.coalesce("origin", F.lit("")) != "compilation"))
    why = first_reason((F.col("by_bridge") | (F.col("kind") == "transcript"), "creator_speech"), (F.col("licensed"), "clip_details"), (F.coalesce("exported", F.lit(0)) == 1, "on_screen_text"), (F.lit(True), "related_meaning"))
    x = x.withColumn("why", why).withColumn("total", F.col("score") + search.ranking_bonus(F.col("why"), True))
    feedback = e.select("id", F.when(F.col("id") % 17 == 0, "not_relevant").when(F.col("id") % 13 == 0, "relevant").alias("verdict"))
    ranked = x.select("id", "why", "by_bridge", "total", "game", "source", "source_date", F.struct((-F.round("total", 9)).alias("t"), "id").alias("rank"))
    return search.with_feedback(ranked, feedback).where("place <= 100").select("id", "why", "by_bridge", F.round("total", 7).alias("score"), "place", "game", "source", "source_date")


def search_pairs(lines, clips):
    """line, clip and gap of clips at most 3 units from a line of the same source."""
    from streamlens.functions.intervals import gap
    from streamlens.operators.intervals import range_join

    j = range_join(lines, clips, ["source"], ("la", "lb"), ("a", "b"), 3.0, 16.0)
    return j.select("line", "clip", gap(F.col("la"), F.col("lb"), F.col("a"), F.col("b")).alias("gap"))


QUERIES, ORACLE = P.queries, P.oracle
