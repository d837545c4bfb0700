"""Exact top-k by inner product: columnar branch-and-bound over blocks.

Vectors become integers, floor(64 * x). Candidates are packed into blocks of a bounded number
of vectors, stored dimension by dimension (vertical layout), and each block goes to one lane; queries are packed into groups of bounded
size, and every lane gets every group. A lane holds up to LANE candidates, so what moves is every candidate once and every query once
a lane. A cell, a group and a block, is two bounded values, whatever the size of a lane. In a cell, partial products are accumulated over
blocks of dimensions. After each block a candidate's product can still grow by at most |rest of q| * |rest of c|; candidates whose
bound is below the query's k-th best sure score so far are dropped and the survivors compacted. While the cells of one group follow
each other, its queries' k best are kept and bound the next cell; one lane gives k rows a query, and the last ranking merges the lanes.

The work is the queries times the candidates. Scores are exact: products that could exceed 2**53 are computed in integers,
and a sum that could exceed 63 bits fails rather than wraps.

Defined cases: null vectors and vectors with null or non-finite components take no part; a
missing component (vectors of unequal length, empty and very long ones) counts as 0; equal scores rank by smaller id; rows with
a repeated id are candidates of their own, other than for a query of that id, and rows of queries with one id are ranked together; an empty
table gives no rows; columns other than id and vector are not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8192
GROUP = 512
#: Candidates of one lane from which on there are more lanes than shuffle partitions.
LANE = 1 << 20
DIMENSIONS = 16
SCALE = 64.0


def _usable(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, fine)


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and v: array<bigint> of floor(64 * x) for every usable vector."""
    v = F.col(vector_column).cast("array<double>")
    return vectors.where(_usable(v) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def _pack(block: int):
    """Rows to blocks: ids, number of dimensions, and the components dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                v = part.column("v")
                sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                dense = np.zeros((part.num_rows, int(sizes.max(initial=0))), np.int64)
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                dense[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                ids = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                narrow = np.int16 if not dense.size or abs(dense).max() < 1 << 15 else np.int64
                columns = [pa.array([ids.tobytes()], pa.binary()), pa.array([dense.shape[1]], pa.int32()), pa.array([np.dtype(narrow).itemsize], pa.int32()), pa.array([np.ascontiguousarray(dense.T.astype(narrow)).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "dims", "width", "data"])

    return run


PACKED = "ids binary, dims int, width int, data binary"


def _unpack(ids: bytes, dims: int, width: int, data: bytes, to: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(ids, "<i8")
    v = np.frombuffer(data, np.int16 if width == 2 else np.int64).reshape(dims, len(key)).astype(np.int64)
    return key, np.concatenate([v, np.zeros((to - dims, len(key)), np.int64)])


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q and c: dimensions x vectors. Gives (query index, candidate index, score): each query's k best of this block.

    floor: a score for each query below which no candidate is wanted (the k-th best found elsewhere).
    """
    dims = len(q)
    top = int(abs(q).max(initial=0)) * int(abs(c).max(initial=0)) * max(dims, 1)
    if top >= 1 << 63:
        raise OverflowError("inner products may exceed 63 bits")
    kind = np.float64 if top < 1 << 53 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    steps = range(0, dims, DIMENSIONS) if dims else range(0)
    # Norms of what is left after each step, in doubles, with a margin for their rounding.
    def rest(x: np.ndarray) -> list[np.ndarray]:
        squares = x.astype(np.float64) ** 2
        return [np.sqrt(squares[s + DIMENSIONS :].sum(0)) * (1 + 1e-9) for s in steps]

    q_rest, c_rest = rest(q), rest(c)
    first = (q[:DIMENSIONS].T @ c[:DIMENSIONS]) if dims else np.zeros((q.shape[1], c.shape[1]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(q.shape[1]):
        alive = np.flatnonzero(c_ids != q_ids[i])
        score = first[i, alive]
        least = -np.inf if floor is None else floor[i]
        for n, s in enumerate(steps):
            if n:
                score = score + q[s : s + DIMENSIONS, i] @ c[s : s + DIMENSIONS, alive]
            if q_rest[n][i] > 0 and (len(alive) > k or least > -np.inf):
                slack = q_rest[n][i] * c_rest[n][alive]
                sure = max(least, np.partition(score - slack, len(alive) - k)[len(alive) - k]) if len(alive) > k else least
                stay = score + slack >= sure - 1e-6 * max(1.0, abs(float(sure)))
                alive, score = alive[stay], score[stay]
        stay = score >= (max(least, np.partition(score, len(alive) - k)[len(alive) - k]) if len(alive) > k else least)
        alive, score = alive[stay], score[stay]
        best = np.lexsort((c_ids[alive], -score))[:k]
        out.append((np.full(len(best), i), alive[best], score[best].astype(np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Best:
    """The k best of every query of one group, over the cells seen so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.query, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), -np.inf)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.vec), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, group: int = GROUP, lane: int = LANE) -> DataFrame:
    """vectors, queries: id and v, as quantized() gives them. Result: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(partitions, -(-vectors.count() // lane))
    groups = max(1, -(-queries.count() // group))
    # Queries are dealt by a hash of their id and packed in pieces of at most one group; a group's number tells it from others.
    dealt = queries.repartition(groups, F.xxhash64("id"))
    q = dealt.mapInArrow(_pack(group), PACKED).select(F.monotonically_increasing_id().alias("q"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("width").alias("q_width"), F.col("data").alias("q_data"))
    q = q.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    c = vectors.mapInArrow(_pack(block), PACKED).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    cells = q.hint("merge").join(c, "lane")
    schema = "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["q_dims"], r["dims"])
                q_ids, qv = _unpack(r["q_ids"], r["q_dims"], r["q_width"], r["q_data"], dims)
                c_ids, cv = _unpack(r["ids"], r["dims"], r["width"], r["data"], dims)
                if r["q"] != now:
                    if best is not None:
                        yield best.rows()
                    now, best = r["q"], _Best(q_ids, k)
                i, j, score = search_block(q_ids, qv, c_ids, cv, k, best.floor)
                best.add(i, c_ids[j], score)
        if best is not None:
            yield best.rows()

    found = cells.select("q", "q_ids", "q_dims", "q_width", "q_data", "ids", "dims", "width", "data").mapInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
