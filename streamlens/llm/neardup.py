"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification, classes.

A document is the multiset of its shingles of five words; similarity is the weighted Jaccard
similarity of two multisets (sum of smaller counts over sum of larger counts), and documents at
0.8 or more are linked. A document of one to four words is one shingle.

Signatures. Every unit of weight of a shingle is a region into which hashed darts fall as a Poisson process
in rank; a last partial unit keeps the darts below its part. Darts up to a rank chosen
for the document's whole weight are thrown, about K (ln K + 4) whatever its length, and each dart
hits one of K coordinates. The earliest dart of each coordinate is its value; two documents agree in
a coordinate with a probability equal to their weighted similarity. A document with an empty
coordinate throws again up to twice the rank.

Joining. BANDS bands of ROWS coordinates: a pair at 0.8 shares no band with probability
(1 - 0.8**6) ** 36 < 2e-5. Texts with equal words are one representative from the start.
Round 1 compares all members of a bucket with its leader. Round 2 takes the documents of
buckets whose members are still in different classes and finds, by an exact prefix-filter join over their shingles, the pairs
of different classes that can reach the similarity; pairs within a class need no comparison. So copies are never
expanded into all pairs, families of near copies do not meet each other pair by pair, and no link between
different classes of a bucket is lost. A pair is first held against the weights' ratio and the
agreement of one-byte sketches of the signatures (six standard deviations below 0.8; chance of
refusing a true pair below 1e-8), then verified exactly on the whole texts.

Defined cases: null and empty texts have no words and are copies of each other; a null doc_id takes no
part and has no row (deduplicate() keeps its row); repeated rows give one row per row; of a class the smallest id stays, of several rows with
that id the one with the smallest digest of its text (equal texts: any); very long texts are handled whole, a text being the smallest unit of work; an empty table gives no rows; other columns are
not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlens.llm import text as tx
from streamlens.llm.graph import components
from streamlens.llm.store import free_name, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
COORDINATES = BANDS * ROWS
#: Document ids (8 bytes each) that select texts for verification are broadcast up to this number, else joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Cells of the table of shingle frequencies (4 bytes each, sent with the code).
FREQUENCIES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COLUMN = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tx.Words, np.ndarray]:
    """(document, shingle hash, count) of each distinct shingle, the words and their hashes."""
    w = tx.words(column)
    h = w.hashes()
    prefix = tx.rolling(h)
    n = np.where(w.counts >= SHINGLE, w.counts - SHINGLE + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + w.first[doc]
    width = np.minimum(SHINGLE, w.counts)[doc]
    s = tx.substring_hash(prefix, at, at + width)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], s[begin], np.diff(np.append(begin, len(s))), w, prefix


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k signatures (uint64) of weighted sets given as rows (set, element hash, weight); sets without weight give zeros."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    todo, factor = total > 0, 1.0
    while todo.any():
        rows = todo[doc]
        d, e, w = doc[rows], element[rows], weight[rows].astype(np.float64)
        columns = np.ceil(w).astype(np.int64)
        of = np.repeat(np.arange(len(d)), columns)
        c = np.arange(len(of)) - np.repeat(np.cumsum(columns) - columns, columns)
        part = np.minimum(1.0, w[of] - c)
        d, e = d[of], tx.mix(e[of] + (c.astype(np.uint64) + np.uint64(1)) * _COLUMN)
        limit = (factor * k * (np.log(k) + 4) / np.maximum(total, 1e-300))[d]
        rank, first, chunk = np.zeros(len(d)), 1, 1
        best = np.full(n * k, np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(d):
            dart = tx.mix(e[:, None] + np.arange(first, first + chunk, dtype=np.uint64) * _STEP)
            ranks = rank[:, None] + np.cumsum(-np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1)
            keep = ranks <= limit[:, None]
            if (part < 1).any():
                height = (tx.mix(dart ^ _COLUMN) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                keep &= height < part[:, None]
            r, col = np.nonzero(keep)
            hit = dart[r, col]
            place = d[r] * k + (((hit & np.uint64(2047)) * np.uint64(k)) >> np.uint64(11)).astype(np.int64)
            np.minimum.at(best, place, ranks[r, col])
            hits.append((place, ranks[r, col], hit))
            more = ranks[:, -1] <= limit
            d, e, limit, part, rank = d[more], e[more], limit[more], part[more], ranks[more, -1]
            first, chunk = first + chunk, min(64, chunk * 4)
        flat = out.reshape(-1)
        for place, ranks_, hit in hits:
            won = ranks_ == best[place]
            flat[place[won]] = hit[won]
        full = np.isfinite(best.reshape(n, k)).all(axis=1)
        todo &= ~full
        factor *= 2
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One key per band; equal only for equal values of the same band (up to 64-bit collisions)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = tx.mix(key * _STEP + parts[:, :, r])
    return key


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, k1 and k2 (hashes of the words), weight, sketch and bands of every document."""
    schema = "doc_id long, k1 long, k2 long, weight long, sketch binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text", tx.BLOCK_BYTES // 2):
                doc, s, count, w, prefix = shingles(part.column("text"))
                n = part.num_rows
                k1 = tx.substring_hash(prefix, w.first[:-1], w.first[1:])
                k2 = tx.substring_hash(tx.rolling(tx.mix(w.hashes() + _COLUMN)), w.first[:-1], w.first[1:])
                weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
                sign = dart_minhash(doc, s, count, n)
                sketch = (tx.mix(sign) & np.uint64(255)).astype(np.uint8)
                keys = bands_of(sign)
                sizes = np.where(weight > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[weight > 0].reshape(-1).view(np.int64)))
                columns = [part.column("doc_id"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(weight), pa.array([x.tobytes() for x in sketch], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id IS NOT NULL").mapInArrow(run, schema)


def weighted_jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact similarity of each pair of texts."""
    n = len(a)
    sides = [shingles(x)[:3] for x in (a, b)]
    doc = np.concatenate([x[0] for x in sides])
    s = np.concatenate([x[1] for x in sides])
    count = np.concatenate([x[2] for x in sides]).astype(np.float64)
    order = np.lexsort((s, doc))
    doc, s, count = doc[order], s[order], count[order]
    same = (doc[1:] == doc[:-1]) & (s[1:] == s[:-1])
    both = np.bincount(doc[1:][same], weights=np.minimum(count[1:], count[:-1])[same], minlength=n)
    total = np.bincount(doc, weights=count, minlength=n)
    return np.where(total > 0, both / np.maximum(total - both, 1e-300), 1.0)


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b whose weights and sketches allow the similarity."""
    floor = threshold - 6 * np.sqrt(threshold * (1 - threshold) / COORDINATES)
    side = reps.select("doc_id", "weight", "sketch")
    wide = pairs.join(side.toDF("a", "wa", "sa"), "a").join(side.toDF("b", "wb", "sb"), "b").where(F.least("wa", "wb") >= threshold * F.greatest("wa", "wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb"))
                yield batch.filter(pa.array((x == y).mean(axis=1) >= floor)).select(["a", "b"])

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The written pairs that reach the threshold on their whole texts."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "verify-ids")
    few = ids.count() <= BROADCAST_IDS
    # doc_id decides: of several rows of an id, those with the representative's words are wanted, and any one does.
    texts = materialize(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "verify-texts")
    wide = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "ta", tx.BLOCK_BYTES // 3):
                yield part.filter(pa.array(weighted_jaccard(part.column("ta"), part.column("tb")) >= threshold - 1e-12)).select(["a", "b"])

    return wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, copy_of (smallest id with the same words), class_id (smallest id of its near-duplicate class) and n_links of every row.

    n_links: other texts, each counted once, to which the row's text was found to be linked. Inside a class pairs are not all compared, so
    it can be below the number of texts at the similarity; it is 0 only where no text but copies is linked.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id IS NOT NULL")
    signed = materialize(signatures(docs), "signatures")
    best = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "weight", "sketch", "bands")).alias("r"))
    reps = materialize(best.select("k1", "k2", "r.*"), "representatives")
    links, root = near_links(docs, reps, threshold)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = root.join(degree, "node")
    found = reps.select("k1", "k2", F.col("doc_id").alias("copy_of")).join(linked, F.col("copy_of") == F.col("node"), "left")
    found = found.select("k1", "k2", "copy_of", F.coalesce("root", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return signed.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "copy_of", "class_id", "n_links")


def prefix_pairs(docs: DataFrame, open_: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs a < b of documents of different classes that can reach the threshold: a prefix-filter join, exact for any order of shingles.

    open_: doc_id and class, written. Shingles are ordered from rare to frequent; two documents that reach the threshold share a
    shingle of their prefixes, the shingles that remain when those at the end weighing less than threshold * weight are left off. What
    makes a family of texts alike is frequent and stands at the end, so families meet only in what few texts have.
    The order needs no exact frequencies: they are counted in a table of FREQUENCIES cells.
    """
    few = open_.count() <= BROADCAST_IDS
    texts = materialize(docs.join(F.broadcast(open_) if few else open_, "doc_id").select("doc_id", "class", "text"), "open-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(FREQUENCIES, np.int64)
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                cells += np.bincount((shingles(part.column("text"))[1] % np.uint64(FREQUENCIES)).astype(np.int64), minlength=FREQUENCIES)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(cells[used])], names=["cell", "n"])

    counted = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(FREQUENCIES, np.uint32)
    frequency[counted.column("cell").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 32) - 1)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                doc, s, weight = shingles(part.column("text"))[:3]
                order = np.lexsort((s, frequency[(s % np.uint64(FREQUENCIES)).astype(np.int64)], doc))
                doc, s, weight = doc[order], s[order], weight[order].astype(np.float64)
                total = np.bincount(doc, weights=weight, minlength=part.num_rows)
                ends = np.cumsum(weight)
                before = ends - weight - (np.cumsum(total) - total)[doc]
                # what starts at this shingle weighs total - before; the prefix goes on while that reaches the threshold
                keep = total[doc] - before >= threshold * total[doc] - 1e-9
                columns = [pa.array(s[keep].view(np.int64)), *(part.column(c).take(pa.array(doc[keep])) for c in ("doc_id", "class"))]
                columns += [pa.array((total[doc] - before)[keep]), pa.array(total[doc][keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "class", "rest", "weight"])

    rows = materialize(texts.mapInArrow(prefixes, "token long, doc_id long, class long, rest double, weight double"), "prefixes")
    mixed = rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("token")
    shared = rows.join(mixed, "token", "left_semi")
    # At its first shared shingle a pair shares at most what remains of either; in all it must share t / (1 + t) of both weights.
    fits = (F.least("ra", "rb") >= threshold / (1 + threshold) * (F.col("wa") + F.col("wb")) - 1e-9) & (F.least("wa", "wb") >= threshold * F.greatest("wa", "wb"))
    pairs = shared.toDF("token", "a", "ca", "ra", "wa").join(shared.toDF("token", "b", "cb", "rb", "wb"), "token").where(fits & F.expr("ca < cb"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(docs: DataFrame, reps: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links a, b between representatives, enough to connect every class; and node, root of the classes."""
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(rows.join(buckets, "key"), "buckets")
    # A bucket's leader is the member that meets most others over all its buckets: of a text and its variants, the text.
    met = members.groupBy("doc_id").agg(F.sum("n").alias("met"))
    ranked = members.join(met, "doc_id").select("key", "doc_id", F.struct("met", (-F.col("doc_id")).alias("id")).alias("place"))
    lead = ranked.groupBy("key").agg((-F.max("place")["id"]).alias("lead"))
    first = members.join(lead, "key").where("doc_id <> lead").select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct()
    first = materialize(first, "first-pairs")
    # a and b can share an id only if that id has rows with different words; such rows are copies by id, not by text
    links = materialize(_verified(materialize(_likely(first, reps, threshold), "pairs"), docs, threshold), "links")
    root = components(links)
    named = members.join(root, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("class"))
    mixed = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    open_ = materialize(named.join(mixed, "key", "left_semi").select("doc_id", "class").distinct(), "open-documents")
    second = prefix_pairs(docs, open_, threshold).join(first, ["a", "b"], "left_anti")
    more = materialize(_verified(materialize(_likely(second, reps, threshold), "pairs"), docs, threshold), "links")
    links = links.unionByName(more)
    return links, components(links)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is the smallest of their class, one row for each; rows with a null id stay."""
    kept, first = free_name(docs.columns, "kept"), free_name(docs.columns, "first")
    found = classes(docs, id_column, text_column, threshold).where("doc_id = class_id").select(F.col("doc_id").alias(kept)).distinct()
    stay = docs.where(F.col(id_column).isNotNull()).join(found, F.col(id_column).cast("long") == F.col(kept), "left_semi")
    order = Window.partitionBy(id_column).orderBy(F.sha2(F.coalesce(text_column, F.lit("")), 256))
    stay = stay.withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).drop(first)
    return stay.unionByName(docs.where(F.col(id_column).isNull()))
