"""Spelling variants: words that differ by one code point, grouped under their most frequent form.

Words are the lower-cased (A-Z only) runs of letters up to U+00FF with MIN_LENGTH code points and MIN_COUNT
occurrences. Two are near if one inserted, deleted or replaced code point turns one into the other. Such an
edit leaves one half intact: with m the shorter length and p the length of the common prefix (0 to m), the pair either
shares its first half (p at or behind the middle) or its last half. So every word is entered in a forward and in
a reversed dictionary, for m equal to its length and to one less; these are range-partitioned and sorted,
and a block is the range of entries with the same m and half. A block of more than BLOCK entries is subdivided before
it is scanned: what is left of the words is halved in the same way, and each entry goes to the two smaller blocks
that extend its known part, until blocks are small or only one place p is left (at most 90 + 90 * 90 words over this alphabet).
A pair belongs to exactly one block, the one whose range of places holds its p, so it is verified and
given once; words in a block are compared a few thousand pairs at a time.

Memory: a task holds one Arrow batch, one block and a slice of the compared pairs. Words are counted in the tasks that
read and combined before the shuffle, so a frequent word is no hot key. A form's n is at least RATIO times
its word's, so chains of forms are short (log of the largest n) and pointer doubling finds the last form in few rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string in the draw
of misspellings; repeated rows count again; very long texts are read whole and very long runs are words like any other; of near words
with the same n the smallest in code-point order is the form; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx
from streamlens.llm.store import materialize

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Entries of a block beyond which it is subdivided.
BLOCK = 64
#: Text bytes counted at once, pairs listed at once, and cells compared at once in a task.
TEXT_BYTES, PAIRS, CELLS = 4 << 20, 1 << 17, 1 << 20
#: Bytes of a run that are digested together with those of other runs.
_TOGETHER = 64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1)).astype(np.uint32)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs of a block of texts: their lower-cased bytes, where each begins in them (one more than runs), and each one's text."""
    letter = _LETTER[data]
    pair = np.flatnonzero(data == 0xC3)  # the first byte of U+00C0 to U+00FF; a continuation byte follows
    letter[pair] = letter[pair + 1] = True
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] |= letter[edges]
    start = np.flatnonzero(begin)
    inside = np.concatenate([[0], np.cumsum(letter)])
    return _LOWER[data[letter]], np.concatenate([inside[start], inside[-1:]]), np.searchsorted(offsets, start, side="right") - 1


def checksums(data: np.ndarray, offsets: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, continued from begun."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    base, state = offsets[:-1][order], ~begun[order].astype(np.uint32)
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(min(longest, _TOGETHER)), side="left")
    for k, n in enumerate(active.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[base[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(lengths), np.uint32)
    out[order] = ~state
    for r in np.flatnonzero(lengths > _TOGETHER).tolist():
        out[r] = zlib.crc32(data[offsets[r] + _TOGETHER : offsets[r + 1]].tobytes(), int(out[r]))
    return out


def _count(part: pa.RecordBatch, min_length: int, noise: int | None) -> pa.RecordBatch:
    """Words of one block of texts with their counts."""
    data, offset, text = runs(*tx.buffers(part.column("text")))
    inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    length = np.diff(offset) - (inner[offset[1:]] - inner[offset[:-1]])
    keep, altered = length >= min_length, []
    if noise:
        ids = ["" if x is None else str(x) for x in part.column("doc_id").to_pylist()]
        begun = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
        drawn = checksums(data, offset, begun[text] if len(text) else np.zeros(0, np.uint32))
        hit = drawn % noise == 0
        for r in np.flatnonzero(hit & (length > min_length)).tolist():
            word, at = data[offset[r] : offset[r + 1]].tobytes().decode(), int(drawn[r]) % int(length[r])
            altered.append(word[:at] + word[at + 1 :])
        keep &= ~hit
    every = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(data)).filter(pa.array(keep))
    counts = pc.value_counts(pa.concat_arrays([every, pa.array(altered, pa.large_string())]))
    return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], names=["word", "n"])


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """word, n and length. With noise, a run whose CRC-32 of "<doc_id>:<run>" it divides loses one code point, as a slip of the pen would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text", TEXT_BYTES):
                yield _count(part, min_length, noise)

    chosen = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    counted = chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count).withColumn("length", F.length("word"))


def _dealt(entries: DataFrame) -> DataFrame:
    """Each entry in the two halves of its range of places [i, j), with the block that names what is known there."""
    middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
    halves = F.array(F.struct("i", middle.alias("j")), F.struct(middle.alias("i"), "j"))
    half = entries.select("word", "n", "length", "m", F.explode(halves).alias("half")).select("word", "n", "length", "m", "half.*")
    suffix = F.greatest(F.col("m") - F.col("j"), F.lit(0))
    known = F.concat_ws(",", "m", "i", "j", F.col("word").substr(F.lit(1), F.col("i")), F.reverse("word").substr(F.lit(1), suffix))
    return half.withColumn("block", known)


def _slices(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified near pairs (row numbers) of sorted, complete blocks."""
    block = rows.column("block")
    m, i, j, length = (rows.column(c).to_numpy() for c in ("m", "i", "j", "length"))
    n = rows.num_rows
    fresh = np.ones(n, bool)
    fresh[1:] = pc.not_equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(fresh)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    raw, _ = tx.buffers(rows.column("word"))
    flat = np.frombuffer(raw.tobytes().decode().encode("latin-1"), np.uint8)  # every letter is one byte
    base = np.cumsum(length) - length
    partners = np.where(length == m, end - np.arange(n) - 1, 0).astype(np.int64)
    upto = np.cumsum(partners)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + PAIRS, side="right")))
        many = partners[row:stop]
        left = np.repeat(np.arange(row, stop), many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        row = stop
        if not len(left):
            continue
        width = int(m[left].max()) + 1
        step = max(1, CELLS // width)
        for k in range(0, len(left), step):
            a, b = left[k : k + step], right[k : k + step]
            yield from _verified(flat, base, length, a, b, i[a], j[a], width)


def _verified(flat, base, length, a, b, i, j, width):
    place = np.arange(width)
    cells = lambda x: np.where(place < length[x][:, None], flat[np.minimum(base[x][:, None] + place, len(flat) - 1)], 0)
    short, long = cells(a), cells(b)
    apart = short != long
    common = apart.argmax(1)
    moved = ((short[:, :-1] != long[:, 1:]) & (place[:-1] >= common[:, None])).any(1)
    near = np.where(length[a] == length[b], apart.sum(1) == 1, ~moved) & (i <= common) & (common < j)
    if near.any():
        yield a[near], b[near]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of a sorted partition; its last block waits for the next batch."""
    def given(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        word, n = rows.column("word"), rows.column("n")
        for a, b in _slices(rows):
            one, two = pa.array(a), pa.array(b)
            yield pa.RecordBatch.from_arrays([word.take(one), n.take(one), word.take(two), n.take(two)], names=["word", "n", "near", "near_n"])

    held = None
    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        block = rows.column("block")
        last = pc.index(block, block[-1]).as_py() if rows.num_rows else 0
        if last:
            yield from given(rows.slice(0, last))
        held = rows.slice(last) if rows.num_rows else held
    if held is not None:
        yield from given(held)


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, near and near_n, once for each near pair. words: word (letters up to U+00FF, each once), n and length."""
    entries = words.select("word", "n", "length", F.explode(F.array("length", F.col("length") - 1)).alias("m")).where("m > 0")
    dealt = materialize(_dealt(entries.select("*", F.lit(0).alias("i"), (F.col("m") + 1).alias("j"))), "entries")
    found: DataFrame | None = None
    while True:
        crowded = materialize(dealt.where("j - i > 1").groupBy("block").count().where(F.col("count") > block).select("block"), "crowded")
        more = crowded.count()
        calm = dealt.join(crowded, "block", "left_anti") if more else dealt
        ranged = calm.repartitionByRange("block").sortWithinPartitions("block", "length", "word")
        pairs = materialize(ranged.mapInArrow(_scan, "word string, n long, near string, near_n long"), "near")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found
        dealt = materialize(_dealt(dealt.join(crowded, "block", "left_semi").select("word", "n", "length", "m", "i", "j")), "entries")


def last_forms(links: DataFrame) -> DataFrame:
    """word and root: the end of each word's chain of forms (links: word, form, with no circle), by pointer doubling."""
    now = materialize(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if not now.where("moved").head(1):
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """Every word with form, root, n, n_near and form_n; words as count_words gives them."""
    words = materialize(words, "words")
    pairs = near_pairs(words, block)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    enough = -F.col("best.order") >= ratio * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")), "best")
    roots = last_forms(best.where("form IS NOT NULL"))
    return (
        words.join(best, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = None) -> DataFrame:
    """variants of the documents' words."""
    return variants(count_words(docs, id_column, text_column, min_length, min_count, noise), ratio)
