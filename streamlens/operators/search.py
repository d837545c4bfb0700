"""Library search: facets, postings, BM25, boolean and phrase matching, vectors, rank fusion, bridges, copies, feedback."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.functions.strings import tokens
from streamlens.shared import written

K1, B = 1.2, 0.75
RRF_K = 60
FEATURES = 32768
#: Code points of a phrase that phrases_in reads for its key, and of one key's piece of it.
SHORTEST_PHRASE, _PIECE = 20, 12


def _equals(word: str):
    return lambda w: w == word


def _starts(prefix: str):
    return lambda w: F.startswith(w, F.lit(prefix))


def facets(kind: str | None = None, decision: str = "all", exported: bool | None = None, origin: str | None = None, game: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """A row's facet condition over columns kind, kept, passed, maybe, exported, origin, game and source_date.

    Null flags count as not set; games compare without case; a null date fails a date range.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1
    rules = []
    if kind:
        rules.append(F.col("kind") == kind)
    if decision in ("kept", "passed", "maybe"):
        rules.append(flag(decision))
    elif decision == "unreviewed":
        rules.append(~flag("kept") & ~flag("passed") & ~flag("maybe"))
    elif decision != "all":
        raise ValueError(f"unknown decision {decision}")
    if exported is not None:
        rules.append(flag("exported") if exported else ~flag("exported"))
    if origin:
        rules.append(F.coalesce("origin", F.lit("")) == origin)
    if game:
        rules.append(F.lower("game") == game.lower())
    if date_from:
        rules.append(F.col("source_date") >= date_from)
    if date_to:
        rules.append(F.col("source_date") <= date_to)
    return reduce(lambda a, b: a & b, rules, F.lit(True))


def postings(docs: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """id, field, term and tf of every word of every field."""
    parts = [docs.select(F.col(id_).alias("id"), F.lit(name).alias("field"), F.explode(tokens(text)).alias("term")) for name, text in fields.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def field_lengths(docs: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """id, field and length in words, with the field's mean length and number of rows."""
    parts = [docs.select(F.col(id_).alias("id"), F.lit(name).alias("field"), F.size(tokens(text)).alias("length")) for name, text in fields.items()]
    every = reduce(DataFrame.unionByName, parts)
    stats = every.groupBy("field").agg(F.avg("length").alias("mean_length"), F.count("*").alias("n"))
    return every.join(F.broadcast(stats), "field")


def counted(docs: DataFrame, id_: str, fields: dict[str, Column], query: list[str], *keep: Column | str, begins: list[str] = (), found: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """id, the kept columns, and per field its length in words and how often each query word stands in it: one row a document, one pass over the texts.

    found: more columns by name, each a function of the first field's words and of the few among them that begin with a query word or with one of begins.
    Words are cut once and stand as columns: within the function of an element, or as the argument of several, they would be cut anew for each.
    """
    few = sorted({*query, *begins})
    words = [c for k, text in enumerate(fields.values()) for c in (tokens(text).alias(f"__w{k}"), tokens(text, few).alias(f"__f{k}"))]
    tf = lambda k: [F.size(F.filter(F.col(f"__f{k}"), _equals(q))).alias(f"tf{k}_{i}") for i, q in enumerate(query)]
    kept = [F.col(c) if isinstance(c, str) else c for c in keep]
    held = docs.select(F.col(id_).alias("id"), *kept, *words)
    more = [f(F.col("__w0"), F.col("__f0")).alias(name) for name, f in (found or {}).items()]
    return held.select("id", *held.columns[1 : 1 + len(keep)], *more, *[c for k in range(len(fields)) for c in (F.size(f"__w{k}").alias(f"length{k}"), *tf(k))])


def bm25_scores(rows: DataFrame, weights: list[float], words: int) -> DataFrame:
    """rows of counted (written: they are read twice) with score: BM25 per field (higher is better), weighted and summed; 0 without any query word.

    Mean lengths and document frequencies are one row, broadcast.
    """
    fields = range(len(weights))
    stats = rows.agg(F.count("*").alias("__n"), *[x for k in fields for x in (F.avg(f"length{k}").alias(f"__mean{k}"), *[F.count_if(F.col(f"tf{k}_{i}") > 0).alias(f"__df{k}_{i}") for i in range(words)])])

    def part(k: int, i: int) -> Column:
        tf, df, n = F.col(f"tf{k}_{i}"), F.col(f"__df{k}_{i}"), F.col("__n")
        value = F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"length{k}") / F.col(f"__mean{k}")))
        return F.when(tf > 0, value).otherwise(0.0)

    score = sum(reduce(lambda a, b: a + b, [part(k, i) for i in range(words)]) * weights[k] for k in fields)
    return rows.join(F.broadcast(stats), F.lit(True)).select(*rows.columns, score.alias("score"))


def bm25(docs: DataFrame, id_: str, fields: dict[str, Column], weights: dict[str, float], query: list[str]) -> DataFrame:
    """id and score (higher is better) of rows with any query word."""
    rows = written(counted(docs, id_, fields, query), "counted")
    return bm25_scores(rows, [weights[f] for f in fields], len(query)).where("score > 0").select("id", "score")


def asked(text: str, stop: list[str] = (), families: list[list[str]] = ()) -> tuple[list[list[str]], list[list[str]]]:
    """What a query's text asks for, as matches reads it: an OR-group of prefixes for each meaningful word outside quotes (its family, or itself), and the words of each quoted phrase."""
    word = r"[^\W]+(?:['_][^\W]+)*"
    clean_text = re.sub(r"\s+", " ", text.replace("\0", " ")).strip()
    phrases = [re.findall(word, p.lower()) for p in re.findall(r'"([^"]+)"', clean_text)]
    rest = [w for w in re.findall(word, re.sub(r'"[^"]+"', " ", clean_text).lower()) if w not in stop]
    groups = [next((sorted(v for v in f if " " not in v and "-" not in v) for f in families if w in f), [w]) for w in rest]
    if not groups and not any(phrases):
        raise ValueError("search for at least one word")
    return groups, [p for p in phrases if p]


def matches(words: Column, prefixes: list[list[str]], phrases: list[list[str]] = ()) -> Column:
    """Every OR-group of prefixes has a word, and every phrase stands as neighbouring words."""
    groups = [reduce(lambda a, b: a | b, [F.exists(words, _starts(p)) for p in g]) for g in prefixes]
    runs = [F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(p) + " ")) for p in phrases]
    return reduce(lambda a, b: a & b, [*groups, *runs], F.lit(True))


def lane(scored: DataFrame, name: str, limit: int) -> DataFrame:
    """The best rows of a lane with their rank from 1 (ties: smaller id)."""
    best = scored.orderBy(F.desc("score"), "id").limit(limit)
    return best.select("id", F.lit(name).alias("lane"), F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse(lanes: list[DataFrame], weights: dict[str, float | tuple[float, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: id, score = sum of weight / (k + rank), lanes in order of name. A weight may be two: of a lane's first row, and of its others."""
    every = reduce(DataFrame.unionByName, lanes)
    pair = {n: v if isinstance(v, tuple) else (v, v) for n, v in weights.items()}
    w = [F.create_map(*[x for n, v in pair.items() for x in (F.lit(n), F.lit(float(v[i])))])[F.col("lane")] for i in (0, 1)]
    weight = F.when(F.col("rank") == 1, w[0]).otherwise(w[1])
    return every.groupBy("id").agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"))


#: What the field that explains a match adds to a score, and the reviewer's decision about a clip.
MATCH_BONUS = {"creator_marker": 0.0100, "creator_speech": 0.0080, "clip_details": 0.0060, "gameplay_event": 0.0050, "chat_activity": 0.0030, "visual_description": 0.0020, "on_screen_text": -0.0015, "related_meaning": 0.0}
DECISION_BONUS = {"kept": 0.0060, "maybe": 0.0015, "passed": -0.0030}


def ranking_bonus(source: Column, prefer_clips: bool = False) -> Column:
    """A small prior by the field that explains a match, and for clips by their decision. Reads kind, kept, maybe and passed."""
    by_source = F.create_map(*[F.lit(x) for pair in MATCH_BONUS.items() for x in pair])[source]
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1
    decided = F.when(flag("kept"), DECISION_BONUS["kept"]).when(flag("maybe"), DECISION_BONUS["maybe"]).when(flag("passed"), DECISION_BONUS["passed"]).otherwise(0.0)
    return by_source + F.when(F.col("kind") == "clip", decided + (0.0040 if prefer_clips else 0.0)).otherwise(0.0)


def result_facets(kind: str | None = None, decision: str = "all", exported: bool | None = None, origin: str | None = None) -> Column:
    """The facets held against fused results: stricter than facets(), a decision or a missing export asks for a clip."""
    rules = [facets(kind, decision, exported, origin)]
    if decision != "all" or exported is False:
        rules.append(F.col("kind") == "clip")
    return reduce(lambda a, b: a & b, rules)


def gated_lane(lane_: DataFrame, controlled: list[DataFrame]) -> DataFrame:
    """A lane that may strengthen what controlled lanes found but bring in nothing else; its ranks are counted anew."""
    ids = reduce(DataFrame.unionByName, [x.select("id") for x in controlled]).distinct()
    left = lane_.join(ids, "id", "left_semi")
    return left.withColumn("rank", F.row_number().over(W.partitionBy("lane").orderBy("rank")))


def bridged(fused: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fused scores with what clips owe to lines spoken in them. pairs: line, clip and gap; a clip takes 1.18 of a line's score, and a little for being
    near, when that is more than its own."""
    best = pairs.join(fused.select(F.col("id").alias("line"), F.col("score").alias("s")), "line").groupBy(F.col("clip").alias("id")).agg(F.max(F.col("s") * 1.18 + 0.0025 / (1 + F.col("gap"))).alias("bridge"))
    return fused.select("id", "score").join(best, "id", "full_outer").select("id", F.greatest("score", "bridge").alias("score"), (F.coalesce("bridge", F.lit(0.0)) > F.coalesce("score", F.lit(0.0))).alias("by_bridge"))


def without_copies(ranked: DataFrame, limit: int, near_start: float = 5.0, near_end: float = 8.0) -> DataFrame:
    """id of the best ranked rows (at most limit of them are looked at) without later copies of a moment: same video and kind, another job, start and
    end near those of a row kept before. ranked: id, rank, video (null: never a copy), kind, job, start, end."""
    top = ranked.orderBy("rank").limit(limit)
    rows = top.groupBy("video", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "job", F.col("start").alias("a"), F.col("end").alias("b")))).alias("x"))

    def step(acc: Column, x: Column) -> Column:
        copy = F.exists(acc, lambda k: (k["job"] != x["job"]) & (F.abs(k["a"] - x["a"]) <= near_start) & (F.abs(k["b"] - x["b"]) <= near_end))
        return F.when(copy, acc).otherwise(F.array_append(acc, x))

    kept = F.when(F.col("video").isNull(), F.col("x")).otherwise(F.aggregate("x", F.array().cast(rows.schema["x"].dataType), step))
    return rows.select(F.explode(kept).alias("k")).select("k.id", "k.rank")


def with_feedback(ranked: DataFrame, feedback: DataFrame, most: int = 1000) -> DataFrame:
    """The best rows (most of them) of ranked without those judged not relevant; relevant ones first, otherwise in order; place counts from 1. feedback: id and verdict."""
    x = ranked.join(feedback, "id", "left").where(F.coalesce("verdict", F.lit("")) != "not_relevant")
    x = x.withColumn("__later", F.coalesce((F.col("verdict") != "relevant").cast("int"), F.lit(1)))
    best = x.orderBy("__later", "rank").limit(most)
    return best.withColumn("place", F.row_number().over(W.orderBy("__later", "rank"))).drop("__later")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def unit(v: Column) -> Column:
    """The vector as doubles over its length; a zero vector stays zero."""
    d = v.cast("array<double>")
    # the length stands beside the values: inside the function of an element it would be summed anew for each
    return F.zip_with(d, F.array_repeat(F.sqrt(dot(d, d)), F.size(d)), lambda x, norm: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def cosine_top(vectors: DataFrame, id_: str, vector: str, query: list[float], k: int, floor: float = 0.02, allowed: DataFrame | None = None) -> DataFrame:
    """id and score of the k nearest rows by cosine above floor; only allowed ids, when given. No row is near an empty query."""
    rows = vectors if allowed is None else vectors.join(allowed, id_, "left_semi")
    norm = math.sqrt(reduce(lambda s, x: s + x * x, query, 0.0))
    q = F.array(*[F.lit(x / norm if norm > 0 else 0.0) for x in query]).cast("array<double>")  # of length 1 once, not for each row
    scored = rows.select(F.col(id_).alias("id"), dot(unit(F.col(vector)), q).alias("score"))
    return scored.where(F.col("score") > floor).orderBy(F.desc("score"), "id").limit(k)


#: Rows of counted features that a task hands on at once.
ROWS = 500


def crc_bucket(term: Column) -> Column:
    return F.crc32(term) % FEATURES


def hashed_counts(docs: DataFrame, id_: str, terms: Column, bucket=crc_bucket) -> DataFrame:
    """id, feature and value: 1 + ln(tf) of terms hashed into FEATURES buckets. Texts are dealt by id once; all that follows by id needs no further shuffle."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that it stays: texts are small, what becomes of them is not
    dealt = docs.withColumnRenamed(id_, "id").repartition(n, "id").select("id", terms.alias("terms"))
    x = dealt.select("id", F.explode("terms").alias("term")).groupBy("id", bucket(F.col("term")).alias("feature")).agg(F.count("*").alias("tf"))
    return x.select("id", "feature", (1 + F.log("tf")).alias("value"))


def hashed_rows(docs: DataFrame, id_: str, terms: Column, bucket=crc_bucket) -> DataFrame:
    """id and row (array of (feature, value), in order of feature) of hashed_counts: what follows works within rows. Texts without terms have none.

    Each text's features are counted by themselves, rows of one id together, as they stream by in order of id: no term becomes a row, so no aggregate outgrows memory and spills.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.withColumnRenamed(id_, "id").repartition(n, "id").sortWithinPartitions("id").select("id", F.transform(terms, bucket).alias("features"))
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the id that may go on, and the features of its rows

        def packed(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(f) for _, f, _ in rows)])
            items = pa.StructArray.from_arrays([np.concatenate([f for _, f, _ in rows]), 1 + np.log(np.concatenate([c for _, _, c in rows]))], names=["feature", "value"])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], of), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items)], names=["id", "row"])

        for batch in batches:
            of, lists, out = batch.column("id").type, batch.column("features"), []
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for i, a, b in zip(batch.column("id").to_pylist(), ends - sizes, ends, strict=True):
                if i != now and held:
                    out.append((now, *np.unique(np.concatenate(held), return_counts=True)))
                    held = []
                    if len(out) == ROWS:
                        yield packed(out, of)
                        out = []
                now = i
                if b > a:
                    held.append(flat[a:b])
            if held:
                held[-1] = held[-1].copy()  # not the whole batch
            if out:
                yield packed(out, of)
        if held:
            yield packed([(now, *np.unique(np.concatenate(held), return_counts=True))], of)

    return dealt.mapInArrow(run, f"id {kind}, row array<struct<feature:bigint,value:double>>")


def weighted_rows(rows: DataFrame, n: DataFrame, features: int = FEATURES) -> DataFrame:
    """rows (written once: they are read twice) with values times ln((1 + n) / (1 + df)) + 1, over each row's length; n: a frame with the number of documents in its column n. Frequencies are one dense array of as many places as there are features, broadcast as a single row."""
    df = rows.select(F.explode("row.feature").alias("feature")).groupBy("feature").agg(F.count("*").alias("df")).join(F.broadcast(n.agg(F.max("n").alias("n"))), F.lit(True))
    idf = rows.sparkSession.range(features).select(F.col("id").alias("feature")).join(df.select("feature", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "feature", "left")
    dense = idf.agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", F.coalesce("idf", F.lit(0.0)).alias("idf")))), lambda x: x["idf"]).alias("__idf"))
    x = rows.join(F.broadcast(dense), F.lit(True))
    scaled = F.transform("row", lambda v: F.struct(v["feature"].alias("feature"), (v["value"] * F.get("__idf", v["feature"].cast("int"))).alias("value")))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v["value"] * v["value"]))
    # the norm stands beside the values: inside the function of an element it would be summed anew for each
    whole = F.zip_with(scaled, F.array_repeat(norm, F.size("row")), lambda v, m: F.struct(v["feature"].alias("feature"), (v["value"] / m).alias("value")))
    return x.select("id", whole.alias("row"))


def neighbours(rows: DataFrame, keys: list[str], index: str, text: str, reach: int, out: str, by_value: bool = True) -> DataFrame:
    """The texts around a row in order: by distance of the index value, or by position."""
    w = W.partitionBy(*keys).orderBy(index)
    frame = w.rangeBetween(-reach, reach) if by_value else w.rowsBetween(-reach, reach)
    return rows.withColumn(out, F.array_join(F.collect_list(text).over(frame), " "))


def excluding(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def sketch_pairs(rows: DataFrame, id_: str, sketch: str, shared: int = 3, floor: float = 0.45) -> DataFrame:
    """a, b (a < b) and similarity of rows whose sketches (arrays of distinct hashes) share so many hashes and reach so high a Jaccard similarity.

    Two sketches that reach the floor share one of the first hashes of each, rarest first, when so many are taken that those left out are
    fewer than floor * size (and fewer than shared): a prefix-filter join, so hashes that many rows have meet nobody.
    """
    x = rows.select(F.col(id_).alias("id"), F.col(sketch).alias("k")).where(F.size("k") >= shared)
    each = x.select("id", F.size("k").alias("n"), F.explode("k").alias("h"))
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "h"))
    need = F.greatest(F.ceil(F.lit(floor) * F.col("n") - 1e-9), F.lit(shared))
    first = counted.withColumn("place", place).where(F.col("place") <= F.col("n") - need + 1).select("h", "id", "n")
    fits = F.expr("x.id < y.id") & (F.least("x.n", "y.n") >= floor * F.greatest("x.n", "y.n") - 1e-9)
    pairs = first.alias("x").join(first.alias("y"), F.expr("x.h = y.h") & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    wide = pairs.join(x.toDF("a", "ka"), "a").join(x.toDF("b", "kb"), "b").withColumn("both", F.size(F.array_intersect("ka", "kb")))
    return wide.withColumn("similarity", F.col("both") / (F.size("ka") + F.size("kb") - F.col("both"))).where((F.col("both") >= shared) & (F.col("similarity") >= floor)).select("a", "b", "similarity")


def piece_keys(text: str) -> np.ndarray:
    """The distinct keys of a text: of every SHORTEST_PHRASE code points in a row, the smallest hash of a piece in them.

    What a text holds is keyed the same in it and alone, so a phrase's key is among its text's. Shorter texts have none.
    """
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(x) < SHORTEST_PHRASE:
        return np.zeros(0, np.int64)
    h = np.zeros(len(x) - _PIECE + 1, np.uint64)
    for i in range(_PIECE):
        h = (h ^ x[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    low = np.lib.stride_tricks.sliding_window_view(h, SHORTEST_PHRASE - _PIECE + 1).min(axis=1)
    return np.unique(low).view(np.int64)


def phrases_in(df: DataFrame, id_column: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """id and hits: how many of the phrases, of SHORTEST_PHRASE code points at least, stand anywhere in its texts; ids without any are left out.

    An equi-join of the texts' keys with the key of each phrase's beginning gives the pairs to
    verify, so neither side has to fit into memory. A phrase counts as often as it is listed, a text as often as its id.
    """

    @F.pandas_udf("array<long>")
    def keyed(column: pd.Series) -> pd.Series:
        return pd.Series([piece_keys(t or "") for t in column], dtype=object)

    p = phrases.where(F.length(phrase) >= SHORTEST_PHRASE).groupBy(F.col(phrase).alias("__p")).agg(F.count("*").alias("__n"))
    p = p.select("__p", "__n", F.explode(keyed(F.left("__p", F.lit(SHORTEST_PHRASE)))).alias("__key"))
    d = df.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
    pairs = d.select("__id", F.explode(keyed("__text")).alias("__key")).join(p, "__key").select("__id", "__p", "__n").distinct()
    at = d.withColumnRenamed("__id", "__at")
    hits = pairs.join(at, F.col("__id").eqNullSafe(F.col("__at"))).where(F.contains("__text", "__p"))
    return hits.groupBy(F.col("__id").alias(id_column)).agg(F.sum("__n").alias("hits"))
