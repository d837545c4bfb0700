"""Latent concepts of texts: a randomised SVD over hashed term vectors, vectors of texts and queries in its basis, and the terms that it knows.

The matrix of texts by features stays row-partitioned and is never multiplied out. Each pass reads the rows once: a task projects its rows on the basis
and adds them back up by feature, so that only one row per feature and task is shuffled. What passes the driver, and is broadcast to the tasks, is the basis: features
* (rank + oversample) doubles, 53 MB for 32,768 features and rank 192, whatever the number of texts. The random start is drawn from the seed in the
tasks. Two power passes sharpen the basis; singular values come from a rank-sized square matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells (terms times basis vectors) that a task multiplies at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Concepts:
    """components: features by rank, orthonormal columns, strongest first; singular: their singular values."""

    components: np.ndarray
    singular: np.ndarray


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, values and row starts of a batch of sparse rows (column row: array of (feature, value))."""
    lists = batch.column("row")
    items = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    return items.field("feature").to_numpy(zero_copy_only=False).astype(np.int64), items.field("value").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _projected(feature: np.ndarray, value: np.ndarray, start: np.ndarray, basis: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, their products with the basis), a slice of rows at a time."""
    most, a, n = max(1, CELLS // basis.shape[1]), 0, len(start) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(start, start[a] + most, side="right")) - 1)
        lo, hi = start[a], start[b]
        out = np.zeros((b - a, basis.shape[1]))
        full = np.flatnonzero(start[a + 1 : b + 1] > start[a:b])
        if hi > lo:
            out[full] = np.add.reduceat(basis[feature[lo:hi]] * value[lo:hi, None], start[a:b][full] - lo)
        yield a, b, out
        a = b


def _start(features: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((features, width))


def _pass(rows: DataFrame, features: int, width: int, basis: np.ndarray | None, seed: int) -> np.ndarray:
    """AᵀA times the basis (the random start, where there is none)."""
    held = rows.sparkSession.sparkContext.broadcast(basis) if basis is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value if held is not None else _start(features, width, seed)
        total, met = np.zeros((features, width)), np.zeros(features, bool)
        for batch in batches:
            feature, value, start = _rows(batch)
            for a, b, y in _projected(feature, value, start, w):
                lo, hi = start[a], start[b]
                order = np.argsort(feature[lo:hi], kind="stable")
                f, first = np.unique(feature[lo:hi][order], return_index=True)
                if len(f):
                    row = np.repeat(np.arange(b - a), np.diff(start[a : b + 1]))
                    total[f] += np.add.reduceat((value[lo:hi, None] * y[row])[order], first)
                    met[f] = True
        f = np.flatnonzero(met)
        for k in range(0, len(f), 4096):
            part = f[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.FixedSizeListArray.from_arrays(total[part].ravel(), width).cast(pa.list_(pa.float64()))], names=["feature", "part"])

    parts = rows.select("row").mapInArrow(run, "feature long, part array<double>")
    summed = parts.groupBy("feature").agg(*[F.sum(F.get("part", F.lit(i))).alias(f"p{i}") for i in range(width)])
    out, table = np.zeros((features, width)), summed.toArrow()
    if table.num_rows:
        out[table.column("feature").to_numpy()] = np.stack([table.column(f"p{i}").to_numpy() for i in range(width)], axis=1)
    if held is not None:
        held.unpersist()
    return out


def fit(rows: DataFrame, features: int, rank: int = 192, oversample: int = 10, power: int = 2, seed: int = 7) -> Concepts:
    """The strongest concepts of sparse rows (id, row: array of (feature, value)). Rank is held to the number of features; rows without any entry count as zero."""
    width = min(features, rank + oversample)
    basis = None
    for _ in range(power):
        basis = np.linalg.qr(_pass(rows, features, width, basis, seed))[0]
    basis = basis if basis is not None else np.linalg.qr(_start(features, width, seed))[0]
    square = basis.T @ _pass(rows, features, width, basis, seed)
    values, turn = np.linalg.eigh((square + square.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(rank, features)]
    return Concepts(basis @ turn[:, order], np.sqrt(np.maximum(values[order], 0.0)))


def project(rows: DataFrame, concepts: Concepts) -> DataFrame:
    """id, vector (unit length in the concepts' basis; zeros for a row without entries) and kept (the length before, of a unit row the share that the concepts keep)."""
    held = rows.sparkSession.sparkContext.broadcast(concepts.components)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, value, start = _rows(batch)
            for a, b, y in _projected(feature, value, start, held.value):
                kept = np.linalg.norm(y, axis=1)
                unit = y / np.where(kept > 0, kept, 1.0)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.FixedSizeListArray.from_arrays(unit.ravel(), unit.shape[1]).cast(pa.list_(pa.float64())), pa.array(kept)], names=["id", "vector", "kept"])

    return rows.select("id", "row").mapInArrow(run, f"id {kind}, vector array<double>, kept double")


def vocabulary(docs: DataFrame, terms: Column) -> DataFrame:
    """Distinct 64-bit fingerprints of all terms of the texts."""
    return docs.select(F.explode(terms).alias("term")).select(F.xxhash64("term").alias("print")).distinct()


def known_terms(queries: DataFrame, id_: str, terms: Column, known: DataFrame) -> DataFrame:
    """id and terms of queries, in order and as often as they stand there, without those whose fingerprint no text has; queries without any are left out."""
    x = queries.select(F.col(id_).alias("id"), F.posexplode(terms).alias("at", "term")).withColumn("print", F.xxhash64("term"))
    left = x.join(known, "print", "left_semi")
    return left.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda v: v["term"]).alias("terms"))
