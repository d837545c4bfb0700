"""Cost-balanced packing of documents into training sequences.

A sequence's cost is estimated as linear * tokens + quadratic * tokens**2 for each piece in
it (attention stays inside a piece). Documents are placed in descending order of cost, each
into the sequence of lowest cost that still has room for it. Documents longer than a
sequence are first cut into whole sequences and a rest; at the end, what fits nowhere whole
is cut to fill the remaining room. Room is planned to equal the block's tokens exactly: whole
sequences, and for the rest sequences whose lengths are powers of two, so nothing is padded.

Packing runs on blocks of about BLOCK_TOKENS tokens inside the tasks that read the
documents: no shuffle, and a task holds one block, whatever the input's size. Sequence ids
are (input partition << 32) + a number counted in it; they are the same whenever the input is
split in the same way.

Defined cases: a null text is empty and has the single end id; a null doc_id is carried
through; repeated rows are packed each for itself; a very long text fills whole sequences of its own first; documents of equal cost go
in the order of the block, to the first of equally cheap sequences; an empty table gives no rows; other columns
are not looked at and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx
from streamlens.llm.tokens import tokenizer, vocabulary_path

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


def costs(tokens: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    t = tokens.astype(np.float64)
    return linear * t + quadratic * t * t


def pack(sizes: np.ndarray, length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / LENGTH):
    """Pieces (document, start, tokens, sequence, offset) as arrays, and the sequences' lengths and costs."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    rest = total % length
    room = np.array([length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    capacity, cost = room.copy(), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, int(capacity[seq] - room[seq])))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    seq = 0
    for doc in np.flatnonzero(sizes >= length).tolist():
        for start in range(0, int(sizes[doc]) - length + 1, length):
            put(doc, start, length, seq)
            seq += 1
    left = sizes % length
    order = np.argsort(-costs(left, linear, quadratic), kind="stable")
    for doc in order[left[order] > 0].tolist():
        n, start = int(left[doc]), int(sizes[doc] - left[doc])
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            best = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(n, int(room[best]))
            put(doc, start, take, best)
            n, start = n - take, start + take
    out = np.array(pieces, np.int64).reshape(-1, 5)
    return out, capacity, cost


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    linear: float = 1.0,
    quadratic: float = 1.0 / LENGTH,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece; see the module's text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, used = tokenizer(path), TaskContext.get().partitionId() << 32, 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal used
            key, flat, size = pa.concat_arrays(keys), np.concatenate(ids).astype("<u4"), np.concatenate(sizes)
            begin = np.cumsum(size) - size
            piece, capacity, cost = pack(size, length, linear, quadratic)
            doc, start, n, seq, offset = piece.T
            at = begin[doc] + start
            crc = np.fromiter((zlib.crc32(flat[a : a + k].data) for a, k in zip(at.tolist(), n.tolist(), strict=True)), np.int64, len(at))
            columns = [key.take(pa.array(doc)), *map(pa.array, (start, n, crc, size[doc], base + used + seq, offset, capacity[seq], cost[seq]))]
            used += len(capacity)
            keys.clear(), ids.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for part in tx.blocks(batch, "text"):
                flat, offset = encode.ids(part.column("text"))
                # each document ends with END_ID
                size = np.diff(offset) + 1
                with_end = np.full(len(flat) + part.num_rows, END_ID, np.uint32)
                with_end[np.arange(len(flat)) + np.repeat(np.arange(part.num_rows), size - 1)] = flat
                keys.append(part.column("doc_id")), ids.append(with_end), sizes.append(size)
                if sum(map(len, ids)) >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
