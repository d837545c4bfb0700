"""Search over documents: facets, text, vectors, fusion, context and explanations.

A document's language stands for its game and its source for its session; labels stand for decisions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from streamlens.functions import strings as st
from streamlens.functions import structures as su
from streamlens.operators import search
from streamlens.plans.base import Plans
from streamlens.session import table
from streamlens.shared import written

P = Plans()
TOKEN = r"[\p{L}\p{N}_']+"
QUERY = ["licensed", "the", "erst"]


def query_vector(vectors, vec_id: int = 3) -> list[float]:
    """The vector that stands for a query; without it nothing is near (an empty list)."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").head()
    return [float(x) for x in row[0]] if row and row[0] else []


def _entries(spark, sf_dir):
    """Documents with the facets' columns."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = d.join(lab, "doc_id", "left")
    return x.select(
        F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 1000, "transcript").otherwise("clip").alias("kind"), F.col("quality").alias("kept"), F.col("toxic").alias("passed"),
        F.lit(None).cast("int").alias("maybe"), (F.col("doc_id") % 7 == 0).cast("int").alias("exported"), F.when(F.col("doc_id") % 5 == 0, "compilation").alias("origin"),
        F.col("lang").alias("game"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-15")).alias("source_date"), "text", "source", "n_chars",
    )


_ENTRIES = """
entries AS (
  SELECT d.doc_id AS id, CASE WHEN n_chars > 1000 THEN 'transcript' ELSE 'clip' END AS kind, quality AS kept, toxic AS passed, NULL::INT AS maybe, (d.doc_id % 7 = 0)::INT AS exported,
         CASE WHEN d.doc_id % 5 = 0 THEN 'compilation' END AS origin, lang AS game, '2024-' || lpad((d.doc_id % 12 + 1)::VARCHAR, 2, '0') || '-15' AS source_date, text, source, n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


@P.add(f"""WITH {_ENTRIES} SELECT id, kind, game, source_date FROM entries
WHERE kind = 'clip' AND coalesce(kept, 0) = 1 AND coalesce(exported, 0) <> 1 AND lower(game) = 'en' AND source_date >= '2024-03-01' AND source_date <= '2024-10-31'""")
def facet_search(spark, sf_dir):
    return _entries(spark, sf_dir).where(search.facets("clip", "kept", False, None, "EN", "2024-03-01", "2024-10-31")).select("id", "kind", "game", "source_date")


@P.add(f"WITH {_ENTRIES} SELECT id FROM entries WHERE coalesce(kept, 0) <> 1 AND coalesce(passed, 0) <> 1 AND coalesce(maybe, 0) <> 1 AND coalesce(origin, '') <> 'compilation'")
def unreviewed_originals(spark, sf_dir):
    return _entries(spark, sf_dir).where(search.facets(decision="unreviewed") & (F.coalesce("origin", F.lit("")) != "compilation")).select("id")


@P.add(f"""WITH {_ENTRIES}, kept AS (SELECT id FROM entries WHERE coalesce(kept, 0) = 1)
SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT id FROM kept)""")
def allowed_vectors(spark, sf_dir):
    kept = _entries(spark, sf_dir).where(search.facets(decision="kept")).select(F.col("id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(kept, "vec_id", "left_semi").select("vec_id", "label")


@P.add(f"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}')) AS term FROM documents)
SELECT term, count(DISTINCT id)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY term HAVING count(DISTINCT id) >= 5""")
def posting_counts(spark, sf_dir):
    p = search.postings(table(spark, sf_dir, "documents"), "doc_id", {"text": F.col("text")})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 5")


def _bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return search.bm25(d, "doc_id", {"text": F.col("text"), "session": F.col("source"), "game": F.col("lang")}, {"text": 1.0, "session": 3.0, "game": 2.0}, QUERY)


_BM25 = f"""
fields AS (
  SELECT doc_id AS id, 'text' AS field, 1.0::DOUBLE AS weight, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') AS w FROM documents
  UNION ALL SELECT doc_id, 'session', 3.0, regexp_extract_all(lower(source), '{TOKEN.replace("'", "''")}') FROM documents
  UNION ALL SELECT doc_id, 'game', 2.0, regexp_extract_all(lower(lang), '{TOKEN.replace("'", "''")}') FROM documents),
stats AS (SELECT field, avg(len(w)) AS mean, count(*) AS n FROM fields GROUP BY field),
hits AS (SELECT id, field, weight, len(w) AS length, q, len(list_filter(w, lambda x: x = q)) AS tf FROM fields CROSS JOIN (SELECT unnest({QUERY}) AS q)),
dfs AS (SELECT field, q, count(*) FILTER (tf > 0) AS df FROM hits GROUP BY 1, 2),
bm AS (
  SELECT id, sum(CASE WHEN tf > 0 THEN weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END) AS score
  FROM hits JOIN stats USING (field) JOIN dfs USING (field, q) GROUP BY id)
"""


@P.add(f"WITH {_BM25} SELECT id, round(score, 5) AS score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 200")
def bm25_top(spark, sf_dir):
    return _bm25(spark, sf_dir).orderBy(F.desc("score"), "id").limit(200).select("id", F.round("score", 5).alias("score"))


@P.add(f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') AS w FROM documents)
SELECT id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'lic') OR starts_with(x, 'rel'))) > 0 AND contains(' ' || array_to_string(w, ' ') || ' ', ' under the ')""")
def boolean_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("w", st.tokens(F.col("text")))
    return d.where(search.matches(F.col("w"), [["lic", "rel"]], [["under", "the"]])).select(F.col("doc_id").alias("id"))


@P.add("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3),
s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)
SELECT id, round(score, 6) AS score FROM s WHERE score > 0.02 ORDER BY score DESC, id LIMIT 50""")
def cosine_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = query_vector(e)
    return search.cosine_top(e, "vec_id", "embedding", q, 50).select("id", F.round("score", 6).alias("score"))


@P.add(f"""WITH {_BM25},
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3),
cs AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q),
lanes AS (
  SELECT id, 'keyword' AS lane, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 100)
  UNION ALL SELECT id, 'semantic', row_number() OVER (ORDER BY score DESC, id) FROM (SELECT * FROM cs WHERE score > 0.02 ORDER BY score DESC, id LIMIT 100)
  UNION ALL SELECT id, 'recent', row_number() OVER (ORDER BY score DESC, id) FROM (SELECT doc_id AS id, doc_id AS score FROM documents ORDER BY 2 DESC LIMIT 100))
SELECT id, round(sum((CASE lane WHEN 'keyword' THEN 1.4 WHEN 'semantic' THEN 0.55 ELSE 0.6 END) / (60 + rank)), 8) AS score, string_agg(lane, ',' ORDER BY lane) AS lanes FROM lanes GROUP BY id""")
def fused_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = query_vector(e)
    recent = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("score"))
    lanes = [search.lane(_bm25(spark, sf_dir), "keyword", 100), search.lane(search.cosine_top(e, "vec_id", "embedding", q, 100), "semantic", 100), search.lane(recent, "recent", 100)]
    return search.fuse(lanes, {"keyword": 1.4, "semantic": 0.55, "recent": 0.6}).select("id", F.round("score", 8).alias("score"), "lanes")


@P.add("""SELECT conv_id, turn, string_agg(text, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM conversations""")
def context_by_value(spark, sf_dir):
    return search.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 2, "around").select("conv_id", "turn", "around")


@P.add("""SELECT conv_id, turn, string_agg(text, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM conversations WHERE role <> 'system' OR turn > 0""")
def context_by_position(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system' OR turn > 0")
    return search.neighbours(c, ["conv_id"], "turn", "text", 2, "around", by_value=False).select("conv_id", "turn", "around")


@P.add("""WITH l AS (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS line, string_split(text, chr(10)) AS parts FROM conversations)
SELECT conv_id, turn, line::INT AS line, parts[line + 1] AS text FROM l WHERE trim(parts[line + 1]) <> ''""")
def flatten_transcript(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "")


@P.add(f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') AS w FROM documents),
t AS (SELECT id, unnest(list_distinct(w)) AS term FROM w), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
x AS (SELECT t.id, t.term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS v FROM t JOIN d USING (term), n)
SELECT id, count(*)::BIGINT AS n_terms, round(sqrt(sum(v * v)), 4) AS norm FROM x GROUP BY id""")
def idf_norms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(st.tokens(F.col("text")))).alias("term"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    x = t.join(df, "term").join(F.broadcast(d.agg(F.count("*").alias("n"))), F.lit(True)).withColumn("v", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    return x.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("norm"))


@P.add(f"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}'), lambda x: x NOT IN ('the', 'de') AND length(x) > 1) AS w FROM documents),
t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1]))) AS term FROM w), c AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 32768 AS feature, 1 + ln(count(*)) AS v FROM t GROUP BY 1, 2),
d AS (SELECT feature, count(*) AS df FROM c GROUP BY 1), x AS (SELECT id, v * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS v FROM c JOIN d USING (feature)), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM x GROUP BY 1)
SELECT x.id, count(*)::BIGINT AS n_features, round(max(v / norm), 6)::DOUBLE AS top, round(sum(v / norm * v / norm), 6)::DOUBLE AS length FROM x JOIN n ON n.id = x.id GROUP BY x.id""")
def hashed_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bucket = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % search.FEATURES
    rows = written(search.hashed_rows(d, "doc_id", st.terms(F.col("text"), ["the", "de"]), bucket), "rows")
    x = search.weighted_rows(rows, d.agg(F.count("*").alias("n")))
    length = F.aggregate("row", F.lit(0.0), lambda s, v: s + v["value"] * v["value"])
    return x.select("id", F.size("row").cast("long").alias("n_features"), F.round(F.array_max("row.value"), 6).alias("top"), F.round(length, 6).alias("length"))


@P.add(f"""WITH b AS (SELECT item_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}'), lambda w: left(sha256(w), 8))))[1:24] AS k FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k)))::DOUBLE, 6) AS similarity FROM b x JOIN b y ON x.item_id < y.item_id WHERE len(list_intersect(x.k, y.k)) >= 3 AND len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k)))::DOUBLE >= 0.1""")
def sketch_pairs(spark, sf_dir):
    """Pairs whose sketches share three hashes and a share of .1 of both."""
    return search.sketch_pairs(table(spark, sf_dir, "benchmark").select("item_id", st.token_sketch(F.col("text"), []).alias("k")), "item_id", "k", 3, 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@P.add(f"""WITH {_ENTRIES} SELECT id, CASE WHEN contains(text, 'Licensed') THEN 'creator_marker' WHEN kind = 'transcript' THEN 'creator_speech' WHEN coalesce(kept, 0) = 1 THEN 'clip_details' WHEN coalesce(exported, 0) = 1 THEN 'chat_activity' ELSE 'related_meaning' END AS reason,
round((CASE WHEN coalesce(kept, 0) = 1 THEN 0.3 ELSE 0 END) + (CASE game WHEN 'en' THEN 0.2 WHEN 'de' THEN 0.1 ELSE 0 END), 3) AS prior FROM entries""")
def match_reason(spark, sf_dir):
    e = _entries(spark, sf_dir)
    kept, exported = F.coalesce("kept", F.lit(0)) == 1, F.coalesce("exported", F.lit(0)) == 1
    reason = su.first_reason((F.contains("text", F.lit("Licensed")), "creator_marker"), (F.col("kind") == "transcript", "creator_speech"), (kept, "clip_details"), (exported, "chat_activity"), (F.lit(True), "related_meaning"))
    prior = F.when(kept, 0.3).otherwise(0.0) + F.when(F.col("game") == "en", 0.2).when(F.col("game") == "de", 0.1).otherwise(0.0)
    return e.select("id", reason.alias("reason"), F.round(prior, 3).alias("prior"))


@P.add("""SELECT doc_id, count(*)::BIGINT AS hits FROM documents JOIN benchmark b ON contains(documents.text, string_split(b.text, '.')[1]) WHERE length(string_split(b.text, '.')[1]) >= 20 GROUP BY doc_id""")
def phrase_hits(spark, sf_dir):
    phrases = table(spark, sf_dir, "benchmark").select(F.split("text", r"\.")[0].alias("phrase")).where(F.length("phrase") >= search.SHORTEST_PHRASE)
    return search.phrases_in(table(spark, sf_dir, "documents"), "doc_id", "text", phrases, "phrase")


@P.add("""SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://(www\\.)?', ''), '[?#].*$', ''), '/+$', '')) AS key FROM pages""")
def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", st.twitch_key(F.col("url")).alias("key"))


@P.add("""SELECT doc_id, sha256(coalesce(lang, '') || chr(10) || coalesce(source, '') || chr(10) || coalesce(text, '')) AS fingerprint FROM documents""")
def content_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", st.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@P.add(f"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS c, regexp_extract_all(lower(text), '{TOKEN.replace("'", "''")}') AS w FROM documents),
s AS (SELECT *, trim(regexp_replace(regexp_replace(translate(upper(replace(c, 'ß', 'ss')), '|!', 'II'), '[^A-Z0-9# ]+', ' ', 'g'), ' +', ' ', 'g')) AS screen FROM n)
SELECT doc_id, length(c)::INT AS n_clean, sha256(array_to_string(w, ' ')) AS phrase, len(w)::INT AS n_words, sha256(screen) AS screen, length(screen)::INT AS n_screen FROM s""")
def normalised_texts(spark, sf_dir):
    """Whole texts cleaned, as words, and as a screen would be read; the long ones as digests."""
    d = table(spark, sf_dir, "documents").withColumn("c", st.clean(F.col("text"))).withColumn("s", st.screen_text(F.col("c")))
    return d.select("doc_id", F.length("c").alias("n_clean"), F.sha2(st.phrase_text(F.col("text"), None), 256).alias("phrase"), F.size(st.tokens(F.col("text"))).alias("n_words"), F.sha2("s", 256).alias("screen"), F.length("s").alias("n_screen"))


QUERIES, ORACLE = P.queries, P.oracle
