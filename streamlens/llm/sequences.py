"""Training-order materialisation of token sequences as fixed-stride binary shards.

1. Texts become ids; each input partition cuts its stream of ids (every document followed by
   the end id) into sequences of a fixed number of tokens, the last one padded. They are
   written once to the shared folder, compressed.
2. A sequence's ordinal is its place in (input partition, place in it); the partitions' starts
   are a running sum over one count per partition.
3. A keyed Feistel permutation of the next power of four above the number of sequences, walked
   along its cycles until it lands below that number, gives each ordinal its slot in the training
   order: a bijection, computed for each row on its own, so nothing is sorted to shuffle.
4. Slots are dealt by ranges of `per_shard` to shards; a shard is one file of fixed-stride
   records in slot order. Record i of shard s is slot s * per_shard + i, at byte i * stride, so a
   reader seeks to any slot, reads on from there, and resumes from the slot it stopped at.

A record is the ids as little-endian 16-bit numbers (32-bit for vocabularies above 65,536)
and one closing byte 0x0A, which Spark's text writer adds; files are committed by Spark's own
protocol, so tasks that run again leave no partial shard.

Defined cases: null texts are empty and give the end id; a null doc_id is carried; repeated
rows are written as often as they come; a very long text runs through as many sequences as it needs; no two sequences share a slot, so
there are no ties; an empty table gives no rows and no shard; other columns are not looked at and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamlens.llm import text as tx
from streamlens.llm.store import fresh_path, materialize
from streamlens.llm.tokens import tokenizer, vocabulary_path

LENGTH = 2048
END_ID = 1
PAD_ID = 0
PER_SHARD = 1024
ROUNDS = 6
KEY = 0x5EED
#: Partition starts (12 bytes each) are broadcast up to this number of rows, else joined by shuffling.
BROADCAST_PARTITIONS = 100_000


def feistel(ordinal: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of 0..total-1, applied to each ordinal."""
    half = max(1, -(-(max(total, 2) - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = tx.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = ordinal.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (tx.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(total)
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """part, place, n_tokens, doc_ids (documents with ids in the sequence, in order) and ids (zstd of the record's numbers)."""
    path = vocabulary or vocabulary_path()
    schema = "part int, place long, n_tokens int, doc_ids array<long>, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part_id, place = tokenizer(path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1)
        kept_ids, kept_size, kept_key = np.zeros(0, np.uint32), np.zeros(0, np.int64), pa.array([], pa.int64())

        def rows(ids: np.ndarray, size: np.ndarray, key: pa.Array, n: int) -> pa.RecordBatch:
            """The first n sequences of ids."""
            nonlocal place
            ends = np.cumsum(size)
            at = np.arange(n) * length
            to = np.minimum(at + length, len(ids))
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, to - 1, side="right")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last - first + 1)]), pa.int32()), key.take(pa.array(np.repeat(first - np.concatenate([[0], np.cumsum(last - first + 1)[:-1]]), last - first + 1) + np.arange(int((last - first + 1).sum())))))
            blobs, crcs = [], []
            for a, b in zip(at.tolist(), to.tolist(), strict=True):
                x = np.full(length, PAD_ID, np.uint32)
                x[: b - a] = ids[a:b]
                crcs.append(zlib.crc32(x[: b - a].astype("<u4").data))
                blobs.append(pack.compress(x.astype(encode.dtype).data))
            out = [pa.array(np.full(n, part_id, np.int32)), pa.array(place + np.arange(n)), pa.array((to - at).astype(np.int32)), lists, pa.array(crcs, pa.int64()), pa.array(blobs, pa.binary())]
            place += n
            return pa.RecordBatch.from_arrays(out, names=["part", "place", "n_tokens", "doc_ids", "ids_crc32", "ids"])

        for batch in batches:
            for part in tx.blocks(batch, "text"):
                flat, offset = encode.ids(part.column("text"))
                size = np.diff(offset) + 1
                ids = np.full(len(flat) + part.num_rows, END_ID, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(part.num_rows), size - 1)] = flat
                kept_ids = np.concatenate([kept_ids, ids])
                kept_size = np.concatenate([kept_size, size])
                kept_key = pa.concat_arrays([kept_key, part.column("doc_id")])
                n = len(kept_ids) // length
                if n:
                    yield rows(kept_ids, kept_size, kept_key, n)
                    kept_ids, used, ends = kept_ids[n * length :], n * length, np.cumsum(kept_size)
                    done = int(np.searchsorted(ends, used, side="right"))
                    rest = kept_size[done:].copy()
                    if len(rest):
                        rest[0] = ends[done] - used
                    kept_size, kept_key = rest, kept_key.slice(done)
        if len(kept_ids):
            yield rows(kept_ids, kept_size, kept_key, 1)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def assign_slots(sequences: DataFrame, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """A written table of sequences with ordinal, slot, shard and record."""
    counts = sequences.groupBy("part").agg(F.count("*").alias("n"))
    starts = materialize(counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"), "n"), "sequence-starts")
    few, total = starts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    starts = starts.select("part", "start")
    rows = sequences.join(F.broadcast(starts) if few <= BROADCAST_PARTITIONS else starts, "part").withColumn("ordinal", F.col("start") + F.col("place")).drop("start")

    @F.pandas_udf("long")
    def slot(ordinal):
        import pandas as pd

        return pd.Series(feistel(ordinal.to_numpy(), total, key))

    return rows.withColumn("slot", slot("ordinal")).withColumn("shard", F.floor(F.col("slot") / per_shard)).withColumn("record", F.col("slot") % per_shard)


def write_shards(rows: DataFrame, path: str, partitions: int) -> None:
    """One file a shard, in the folder shard=<number>; records in slot order.

    A shard is one row of the writer, put together in the task that holds its range of slots, so the order of
    its records does not depend on how the writer sorts or spills. per_shard of assign_slots() bounds that row.
    """
    schema = "shard long, value binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, held = zstandard.ZstdDecompressor(), None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"\n".join(held)], pa.binary())], names=["shard", "value"])

        for b in batches:
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids"), strict=True):
                if shard != now and held:
                    yield whole()
                    held.clear()
                now = shard
                held.append(unpack.decompress(ids.as_py()))
        if held:
            yield whole()

    ordered = rows.select("shard", "slot", "ids").repartitionByRange(partitions, "shard").sortWithinPartitions("shard", "slot").select("shard", "ids")
    # A binary's bytes pass unchanged through the cast and the text writer.
    ordered.mapInArrow(join, schema).select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(path)


def read_slots(spark: SparkSession, path: str, length: int = LENGTH, width: int = 2) -> DataFrame:
    """shard, record and value of all records, read back by their stride."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{path}/shard=*/*.txt")
    stride = length * width + 1
    schema = "path string, record long, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = data.as_py()
                n = len(data) // stride
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([data[i * stride : (i + 1) * stride - 1] for i in range(n)], pa.binary())], names=["path", "record", "value"])

    found = files.select("path", "content").mapInArrow(run, schema)
    return found.select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard"), "record", "value")


def materialise_order(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write the shards and give one row per sequence: ordinal, slot, shard, record, n_tokens, doc_ids, ids_crc32."""
    spark = docs.sparkSession
    sequences = materialize(cut_sequences(docs, id_column, text_column, vocabulary, length), "sequences")
    rows = assign_slots(sequences, per_shard, key)
    write_shards(rows, path or fresh_path(spark, "shards"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("ordinal", "slot", "shard", "record", "n_tokens", "doc_ids", "ids_crc32")
