"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words (every word of the text is in one). A
passage is encoded from what it says, the mean of learned vectors of its hashed words, word beginnings and word ends (BUCKETS vectors), and from
how it is written, statistics of its words and the shares of their shapes, into a hidden vector; gated attention weighs the passages of a
document, and the weighted sum is scored. Word vectors, encoder, attention and score are learned together from document labels
(Adam on the cross-entropy), so what makes a document good or bad is located without passage
labels.

Training uses at most TRAIN_DOCUMENTS labelled documents, those first by a hash of their id, and of a longer one TRAIN_PASSAGES passages spread
evenly over it; only these passages' encoder inputs come to the driver, so their size is bounded. Scoring covers every passage of every document,
block by block in the tasks that read it, without a shuffle.

Defined cases: a null or empty text is a bag of one empty passage; very long texts are scored whole; labels that are null are not
used, and of several labels of a document the smallest counts; a null doc_id is scored and not
held out; repeated rows are scored each for itself; equal texts get equal scores; without any usable label every score is 0.5; an empty table
gives no rows; other columns are carried by score() under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx

PASSAGE_WORDS = 48
SHAPES = 64
STATISTICS = 12
FEATURES = STATISTICS + SHAPES
HIDDEN = 16
#: Vectors that hashed words and word parts share, and how many of them a word has (itself, its beginning, its end).
BUCKETS, PARTS, AFFIX = 1 << 12, 3, 3
TRAIN_DOCUMENTS = 6000
TRAIN_PASSAGES = 64
EPOCHS = 8
THRESHOLD = 0.3


def _table(values) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(values)] = 1
    return out


_UPPER = _table(range(0x41, 0x5B))
_LOWER = _table(range(0x61, 0x7B))
_DIGIT = _table(range(0x30, 0x3A))
_ENDING = _table(b".,;:!?")
_SYMBOL = _table(set(range(0x21, 0x7F)) - set(b".,;:!?'\"()-") - {x for x in range(256) if _UPPER[x] or _LOWER[x] or _DIGIT[x]})
_WIDE = _table(range(0x80, 0x100))


@dataclass
class Bags:
    """Passages of documents: statistics (rows), each document's first row, and each row's bucket ids in one flat array."""

    x: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    start: np.ndarray

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, ids and start of the given rows."""
        n = self.start[at + 1] - self.start[at]
        to = np.cumsum(n)
        flat = np.repeat(self.start[at] - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)
        return self.x[at], self.ids[flat], np.concatenate([[0], to])


def word_buckets(w: tx.Words) -> np.ndarray:
    """words x PARTS: the buckets of each word, of its first AFFIX bytes and of its last."""
    prefix = tx.rolling(w.data.astype(np.uint16) + 1)
    spans = [(w.start, w.end), (w.start, np.minimum(w.start + AFFIX, w.end)), (np.maximum(w.end - AFFIX, w.start), w.end)]
    return np.stack([tx.mix(tx.substring_hash(prefix, a, b) + np.uint64(k)) % np.uint64(BUCKETS) for k, (a, b) in enumerate(spans)], axis=1).astype(np.uint16)


def bags(column: pa.Array) -> Bags:
    """The bags of a column of texts."""
    w = tx.words(column)
    x, first = passages(w)
    n = np.zeros(len(x), np.int64)
    for k in range(len(first) - 1):
        rows, words = first[k + 1] - first[k], int(w.counts[k])
        n[first[k] : first[k + 1]] = np.minimum(PASSAGE_WORDS, words - PASSAGE_WORDS * np.arange(rows))
    return Bags(x, first, word_buckets(w).reshape(-1), np.concatenate([[0], np.cumsum(np.maximum(n, 0) * PARTS)]))


def passages(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages, and each document's first row."""
    counts = w.counts
    n_passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first[-1])
    doc = w.doc()
    within = np.arange(len(doc)) - w.first[doc]
    of = first[doc] + within // PASSAGE_WORDS
    size = (w.end - w.start).astype(np.float64)

    def per_word(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[w.data])])
        return (sums[w.end] - sums[w.start]).astype(np.float64)

    upper, lower, digit, ending, symbol, wide = map(per_word, (_UPPER, _LOWER, _DIGIT, _ENDING, _SYMBOL, _WIDE))
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pair = np.stack([of.astype(np.uint64), h]) if len(h) else np.zeros((2, 0), np.uint64)
    order = np.lexsort(pair)
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(pair[0][order].astype(np.int64)) != 0) | (pair[1][order][1:] != pair[1][order][:-1])
    distinct = np.zeros(len(h))
    distinct[order] = new
    bare = (upper + lower + digit + wide) == 0
    shout = (upper > 1) & (lower == 0)
    shape = tx.mix((np.minimum(size, 15) // 2 + 8 * np.minimum(upper, 2) + 24 * (lower > 0) + 48 * np.minimum(ending, 2) + 144 * np.minimum(symbol, 3) + 576 * (digit > 0) + 1152 * again).astype(np.uint64)) % np.uint64(SHAPES)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=total)

    n = np.bincount(of, minlength=total).astype(np.float64)
    words, chars = np.maximum(n, 1), np.maximum(summed(size), 1)
    letters = np.maximum(summed(upper) + summed(lower) + summed(wide), 1)
    out = np.zeros((total, FEATURES), np.float32)
    out[:, 0] = np.log1p(n) / 4
    out[:, 1] = summed(size) / words / 10
    out[:, 2] = summed(upper) / letters
    out[:, 3] = summed(digit) / chars
    out[:, 4] = summed(ending) / words
    out[:, 5] = summed(symbol) / words
    out[:, 6] = summed(wide) / chars
    out[:, 7] = summed(again.astype(np.float64)) / words
    out[:, 8] = summed(distinct) / words
    out[:, 9] = summed(bare.astype(np.float64)) / words
    out[:, 10] = summed(shout.astype(np.float64)) / words
    out[:, 11] = n == 0
    out[:, STATISTICS:] = np.bincount(of * SHAPES + shape.astype(np.int64), minlength=total * SHAPES).reshape(total, SHAPES) / words[:, None]
    return out, first


@dataclass
class Model:
    """Parameters of encoder, gated attention and score; mean and scale standardise the statistics."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def said(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The mean vector of each passage's words and word parts; zeros for a passage without words."""
        n = np.diff(start)
        out = np.zeros((len(n), HIDDEN), self.p["e"].dtype)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.p["e"][ids], start[some], axis=0) / n[some][:, None]
        return out

    def forward(self, x: np.ndarray, first: np.ndarray, ids: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + self.said(ids, start) + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(a - np.maximum.reduceat(a, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], first[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "bag": bag, "weight": weight, "z": z, "score": score}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, ids: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first, ids, start)
        ds = (f["score"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        bag, weight, h = f["bag"], f["weight"], f["h"]
        dh = dz[bag] * weight[:, None]
        dw = (dz[bag] * h).sum(1)
        da = weight * (dw - np.add.reduceat(weight * dw, first[:-1])[bag])
        tg = f["t"] * f["g"]
        dt = da[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = da[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["v"].T + dg @ p["u"].T
        dpre = dh * (1 - h**2)
        n = np.diff(start)
        row = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(row * BUCKETS + ids, minlength=len(n) * BUCKETS).astype(np.float32).reshape(-1, BUCKETS)
        de = counts.T @ (dpre / np.maximum(n, 1)[:, None]).astype(np.float32)
        return {"w": f["x"].T @ dpre, "b": dpre.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": tg.T @ da, "c": f["z"].T @ ds, "d": np.array([ds.sum()]), "e": de}


def fit(data: Bags, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w": normal(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": normal(HIDDEN, HIDDEN), "u": normal(HIDDEN, HIDDEN), "a": normal(HIDDEN), "c": normal(HIDDEN), "d": np.zeros(1), "e": rng.normal(0, 0.1, (BUCKETS, HIDDEN)).astype(np.float32)}
    model = Model(data.x.mean(0), data.x.std(0) + 0.05, p)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    first, sizes = data.first, np.diff(data.first)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            begin = np.concatenate([[0], np.cumsum(sizes[docs])])
            x, ids, start = data.rows(np.repeat(first[docs] - begin[:-1], sizes[docs]) + np.arange(begin[-1]))
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, g in model.gradients(x, begin, y[docs], ids, start).items():
                g = g + decay * p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out():
    """The documents on which quality is tested; never trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, target: str = "quality") -> Model | None:
    """docs: doc_id and text; labels: doc_id and the target. None when nothing can be learned from."""
    usable = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).cast("double").alias("y")).where(~held_out())
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.blocks(b, "text"):
                data = bags(part.column("text"))
                out = []
                for a, z in zip(data.first[:-1].tolist(), data.first[1:].tolist(), strict=True):
                    chosen = a + np.arange(z - a) if z - a <= TRAIN_PASSAGES else a + np.arange(TRAIN_PASSAGES) * (z - a) // TRAIN_PASSAGES
                    x, ids, start = data.rows(chosen)
                    out.append((x.tobytes(), ids.tobytes(), np.diff(start).astype(np.uint8).tobytes()))
                blobs = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *blobs], names=["doc_id", "y", "x", "ids", "n"])

    got = sorted(rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, x binary, ids binary, n binary").collect())
    if len({r["y"] for r in got}) < 2:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, FEATURES)
    ids = np.frombuffer(b"".join(r["ids"] for r in got), np.uint16)
    n = np.frombuffer(b"".join(r["n"] for r in got), np.uint8).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(r["n"]) for r in got])])
    return fit(Bags(x, first, ids, np.concatenate([[0], np.cumsum(n)])), np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Model | None, name: str = "quality_score") -> DataFrame:
    """All columns of docs, then the score under a name that docs must not have: scored where the documents are read."""
    names = docs.columns
    temporary = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    schema = f"{', '.join(f'c{i} {f.dataType.simpleString()}' for i, f in enumerate(docs.schema.fields))}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.blocks(b, f"c{at}"):
                if model is None:
                    found = np.full(part.num_rows, 0.5)
                else:
                    data = bags(part.column(at))
                    found = model.forward(data.x, data.first, data.ids, data.start)["score"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, "score"])

    return temporary.mapInArrow(run, schema).toDF(*names, name)


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels.select("doc_id", "quality"), limit)
    temporary = score(docs, model).drop("text")
    return temporary.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
