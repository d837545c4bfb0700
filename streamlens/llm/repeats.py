"""Substring dedup: words covered by a window of WINDOW words that also starts earlier are taken out.

The repeats wanted are the internal nodes of depth WINDOW or more in the suffix tree of all texts. The tree is built in parts:

1. Anchors. In every window the run of SEED words with the smallest hash is its anchor; equal windows have equal
   anchors in equal places. Neighbouring windows share anchors, so there are about seven times fewer of
   them than windows. An anchor met only once in the corpus cannot lie in a repeat: its windows are leaves of the tree and go no further.
2. Groups. The suffixes of the other windows travel in chunks: the windows of one anchor, with all their words. The prefix that
   decides the group has one of two lengths: the anchor's SEED words, or, for an anchor met HEAVY times or more, all WINDOW words of
   the window itself, which then travels alone. So a phrase in very many documents is spread over the groups by what surrounds it. The number of groups
   follows the bytes of the texts (GROUP_BYTES a group). Equal chunks in a task count once; the later ones are repeats already. A task that
   meets an anchor HEAVY times by itself says so to the anchor's group and does not send its places there.
3. Subtrees. A group sorts the suffixes of its chunks by prefix doubling and finds the common prefixes of neighbours: the suffix array
   with its LCP values is the subtree. Its topmost nodes of depth WINDOW or more are the repeats; in each, all suffixes but the first
   (smallest doc_id, then start) give windows to take out; neighbouring ones leave as intervals.
4. The intervals meet their documents once, where the words that they cover are taken out.

What is compared are words by 64-bit hashes, rank by rank; no hash of a whole window decides.

Defined cases: null and empty texts have no words and the digest of an empty text; texts below WINDOW words lose
nothing; very long texts are handled whole, a text being the smallest unit of work; a null doc_id takes no part and keeps its words; rows
repeated with their doc_id are one document and treated alike; of equal windows the first by doc_id, then start, stays; an empty table gives
no rows; other columns are not looked at and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx
from streamlens.llm.store import materialize

WINDOW = 20
SEED = 8
HEAVY = 4096
#: Entries that a task gathers before it sends them.
FLUSH = 1 << 20
#: Bytes of text a group stands for: its chunks, and its anchors' places, are a part of that.
GROUP_BYTES = 64 << 20


def _planes(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes (the high bytes of small numbers vanish)."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unplanes(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def window_anchors(w: tx.Words, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of every window of the block, the first word of its anchor, and the hashes of all seeds."""
    h = w.hashes()
    n = np.maximum(w.counts - window + 1, 0)
    start = np.repeat(w.first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    seeds = tx.window_hash(tx.rolling(h), np.arange(len(h) - seed + 1), seed)
    # the place of the smallest seed in width positions, the leftmost of equals, by doubling
    width, best, have = window - seed + 1, np.arange(len(seeds)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(seeds[left] <= seeds[right], left, right)
        have += step
    return start, best[start], seeds


def anchor_marks(docs: DataFrame, groups: int, window: int = WINDOW, seed: int = SEED, heavy: int = HEAVY) -> DataFrame:
    """doc_id, at (the anchor's first word) and heavy of every occurrence of an anchor that the corpus has more than once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            key, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, doc, at = key[order], doc[order], at[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(key)))
            key, often = key[begin], np.repeat(count >= heavy, count)
            rows, none = [], _planes(np.zeros(0, np.int64))
            for i in range(0, int(often.sum()), 1 << 16):  # places of heavy anchors, to groups of their own
                d = doc[often][i : i + (1 << 16)]
                rows.append((int(_group(tx.mix(d[:1].astype(np.uint64)), groups)[0]), none, none, none, _planes(d), _planes(at[often][i : i + (1 << 16)])))
            doc, at = doc[~often], at[~often]
            have = np.where(count >= heavy, 0, count)
            group = _group(key, groups)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(key)]])
            ends = np.concatenate([[0], np.cumsum(have)])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k, own = slice(a, b), slice(ends[a], ends[b])
                rows.append((int(group[a]), _planes(np.diff(key[k], prepend=np.uint64(0))), _planes(count[k].astype(np.int32)), _planes(have[k].astype(np.int32)), _planes(doc[own]), _planes(at[own])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("group", pa.int32()), ("key", pa.binary()), ("count", pa.binary()), ("have", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())]))

        size = 0
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                w = tx.words(part.column("text"))
                _, anchor, seeds = window_anchors(w, window, seed)
                anchor = anchor[np.append(True, anchor[1:] != anchor[:-1])] if len(anchor) else anchor
                if len(anchor):
                    doc = np.searchsorted(w.first, anchor, side="right") - 1
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    held.append((seeds[anchor], ids[doc], (anchor - w.first[doc]).astype(np.int32)))
                    size += len(anchor)
                if size >= FLUSH:
                    yield from packed()
                    size = 0
        if held:
            yield from packed()

    def reduce(table: pa.Table) -> pa.Table:
        key, count, have, doc, at = [], [], [], [], []
        sure_doc, sure_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for r in table.to_pylist():
            own = _unplanes(r["doc"], np.int64), _unplanes(r["at"], np.int32)
            keys = np.cumsum(_unplanes(r["key"], np.uint64), dtype=np.uint64)
            if not len(keys):
                sure_doc.append(own[0]), sure_at.append(own[1])
                continue
            key.append(keys), doc.append(own[0]), at.append(own[1])
            count.append(_unplanes(r["count"], np.int32)), have.append(_unplanes(r["have"], np.int32))
        sure_doc, sure_at = np.concatenate(sure_doc), np.concatenate(sure_at)
        if not key:
            return pa.table({"doc_id": sure_doc, "at": sure_at, "heavy": np.ones(len(sure_doc), bool)})
        key, count, have, doc, at = (np.concatenate(x) for x in (key, count, have, doc, at))
        _, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=count)[inverse]
        every = np.repeat(total, have)
        keep = every > 1
        return pa.table({"doc_id": np.concatenate([doc[keep], sure_doc]), "at": np.concatenate([at[keep], sure_at]), "heavy": np.concatenate([every[keep] >= heavy, np.ones(len(sure_doc), bool)])})

    packed = docs.mapInArrow(emit, "group int, key binary, count binary, have binary, doc binary, at binary")
    return packed.groupBy("group").applyInArrow(reduce, "doc_id long, at int, heavy boolean")


def subtree(h: np.ndarray, last: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The topmost nodes of at least this depth in the suffix tree of the given suffixes.

    h: values of all chunks, one after another; last: the end of each position's chunk; suffixes: positions, each running to its chunk's end.
    Gives the suffixes in the order of the tree, the node of each (nodes are runs in that order; a run of one is a leaf), and the nodes' depths,
    the lengths of the longest prefix that all suffixes of the node share.
    """
    n, longest = len(h), int((last - np.arange(len(h))).max(initial=0))
    # rank[j]: order of the first 2**j values, cut off at the chunk's end; 0 is the end itself
    rank = [np.unique(h, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1]
    place = np.arange(n)
    while 1 << len(rank) - 1 < longest:
        after = place + (1 << len(rank) - 1)
        second = np.where(after < last, rank[-1][np.minimum(after, n - 1)], 0)
        rank.append(np.unique(rank[-1] * (n + 2) + second, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1)
    order = suffixes[np.argsort(rank[-1][suffixes], kind="stable")]
    x, y, common = order[:-1], order[1:], np.zeros(max(len(order) - 1, 0), np.int64)
    for j in range(len(rank) - 1, -1, -1):
        a, b = x + common, y + common
        full = (a + (1 << j) <= last[x]) & (b + (1 << j) <= last[y])
        common += np.where(full & (rank[j][np.minimum(a, n - 1)] == rank[j][np.minimum(b, n - 1)]), 1 << j, 0)
    new = np.ones(len(order), bool)
    new[1:] = common < depth
    node = np.cumsum(new) - 1
    depths = last[order[new]] - order[new]
    np.minimum.at(depths, node[1:][~new[1:]], common[~new[1:]])
    return order, node, depths


def repeated_windows(marked: DataFrame, groups: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, start and n: runs of n neighbouring windows that also start earlier. marked: doc_id, text, marks (array of at and heavy)."""
    names = ["group", "text", "size", "windows", "doc", "start", "gone_doc", "gone_start", "gone_n"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            group, key, size, windows, doc, start = (np.concatenate([x[i] for x in held]) for i in range(6))
            raw = np.frombuffer(b"".join(x[6] for x in held), np.uint8)
            at = np.cumsum(size) - size
            held.clear()
            order = np.lexsort((start, doc, key))
            new = np.ones(len(order), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            a, b = order, order[lead]
            later = (doc[a] != doc[b]) | (start[a] != start[b])
            gone = a[~new & later]
            kept = order[new]
            kept = kept[np.argsort(group[kept], kind="stable")]
            cut = np.flatnonzero(np.diff(group[kept])) + 1
            rows, empty = [], _planes(np.zeros(0, np.int64))
            compress = zstandard.ZstdCompressor(level=1).compress
            for i, k in enumerate(np.split(kept, cut)):
                s = size[k]
                flat = raw[np.repeat(at[k] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))]
                g = gone if not i else gone[:0]
                rows.append((int(group[k[0]]), compress(flat.tobytes()), _planes(s), _planes(windows[k]), _planes(doc[k]), _planes(start[k]), *((_planes(doc[g]), _planes(start[g]), _planes(windows[g])) if len(g) else (empty,) * 3)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("group", pa.int32()), *((c, pa.binary()) for c in names[1:])]))

        total = 0
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                w = tx.words(part.column("text"))
                begin, anchor, seeds = window_anchors(w, window, seed)
                if not len(begin):
                    continue
                marks = part.column("marks")
                flat = marks.flatten()
                of = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
                place = w.first[of] + flat.field("at").to_numpy(zero_copy_only=False)
                state = np.zeros(len(w.start), np.uint8)
                state[place] = 1 + flat.field("heavy").to_numpy(zero_copy_only=False)
                live = state[anchor] > 0
                begin, anchor = begin[live], anchor[live]
                if not len(begin):
                    continue
                big = state[anchor] == 2
                # a chunk: neighbouring windows of one anchor; a heavy anchor's windows stand alone
                new = np.ones(len(begin), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1) | big[1:]
                first = np.flatnonzero(new)
                run = np.diff(np.append(first, len(begin)))
                a, alone = begin[first], big[first]
                z = a + run - 1 + window
                hashes = w.hashes()
                prefix = tx.rolling(hashes)
                key = tx.substring_hash(prefix, a, z)
                group = _group(np.where(alone, key, tx.mix(seeds[anchor[first]] + np.uint64(1))), groups)
                doc = np.searchsorted(w.first, a, side="right") - 1
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                # the chunk's words, each followed by one space
                n = z - a
                word = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                text, lengths = joined(w, word)
                size = np.add.reduceat(lengths, np.cumsum(n) - n)
                held.append((group, key, size, run, ids[doc], a - w.first[doc], text.tobytes()))
                total += len(first)
                if total >= FLUSH // 8:
                    yield packed()
                    total = 0
        if held:
            yield packed()

    def reduce(table: pa.Table) -> pa.Table:
        texts, columns = [], {c: [] for c in names[2:]}
        decompress = zstandard.ZstdDecompressor().decompress
        for r in table.to_pylist():
            texts.append(decompress(r["text"]))
            for c in names[2:]:
                columns[c].append(_unplanes(r[c], np.int64))
        size, windows, doc, start, gone_doc, gone_start, gone_n = (np.concatenate(columns[c]) for c in names[2:])
        w = tx.words_of(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)]))
        chunk = np.repeat(np.arange(len(size)), windows)
        shift = np.arange(len(chunk)) - np.repeat(np.cumsum(windows) - windows, windows)
        position = w.first[chunk] + shift
        tree, of, _ = subtree(w.hashes(), np.repeat(w.first[1:], w.counts), position, window)
        node, d, s = np.empty(len(position), np.int64), doc[chunk], start[chunk] + shift
        node[np.argsort(position, kind="stable")] = of[np.argsort(tree, kind="stable")]  # positions differ
        order = np.lexsort((s, d, node))
        new = np.ones(len(order), bool)
        new[1:] = node[order][1:] != node[order][:-1]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = (d[order] != d[lead]) | (s[order] != s[lead])
        hit = np.flatnonzero(later)
        split = np.ones(len(hit), bool)
        split[1:] = (chunk[hit][1:] != chunk[hit][:-1]) | (shift[hit][1:] != shift[hit][:-1] + 1)
        first = np.flatnonzero(split)
        n = np.diff(np.append(first, len(hit)))
        return pa.table({"doc_id": np.concatenate([d[hit[first]], gone_doc]), "start": np.concatenate([s[hit[first]], gone_start]).astype(np.int32), "n": np.concatenate([n, gone_n]).astype(np.int32)})

    packed = marked.mapInArrow(emit, "group int, " + ", ".join(f"{c} binary" for c in names[1:]))
    return packed.groupBy("group").applyInArrow(reduce, "doc_id long, start int, n int")


def joined(w: tx.Words, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given words, each followed by a space, and their lengths with it."""
    lengths = w.end[word] - w.start[word] + 1
    to = np.cumsum(lengths)
    at = np.repeat(w.start[word] - (to - lengths), lengths) + np.arange(int(to[-1]) if len(to) else 0)
    out = w.data[np.minimum(at, max(len(w.data) - 1, 0))] if len(w.data) else np.zeros(0, np.uint8)
    out = out.copy()
    out[to - 1] = 0x20
    return out, lengths


def _intervals(docs: DataFrame, window: int, seed: int, heavy: int) -> DataFrame:
    """doc_id and gone: an array of (start, n) of the windows to take out."""
    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    marks = anchor_marks(usable, groups, window, seed, heavy).groupBy("doc_id").agg(F.collect_list(F.struct("at", "heavy")).alias("marks"))
    marked = usable.join(marks, "doc_id").select("doc_id", "text", "marks")
    runs = materialize(repeated_windows(marked, groups, window, seed), "repeats")
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed: int = SEED, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256 of every row."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    gone = _intervals(docs, window, seed, heavy)
    rows = docs.join(gone, "doc_id", "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<struct<start:int,n:int>>")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                w = tx.words(part.column("text"))
                runs = part.column("gone")
                flat = runs.flatten()
                of = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
                a = w.first[of] + flat.field("start").to_numpy(zero_copy_only=False)
                step = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, a + flat.field("n").to_numpy(zero_copy_only=False) - 1 + window, -1)
                stay = np.cumsum(step)[:-1] == 0
                raw, lengths = joined(w, np.flatnonzero(stay))
                kept = np.diff(np.concatenate([[0], np.cumsum(stay)])[w.first])
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(kept)])]
                data = raw.tobytes()
                texts = [data[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array((w.counts - kept).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
