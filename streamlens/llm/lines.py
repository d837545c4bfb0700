"""Line dedup by a segment-partition edit join.

Lines are what stands between line feeds. Two lines are linked when their edit distance (insert,
delete, replace a code point) is at most edits(shorter) = min(MAX_EDITS, length // CHARS_PER_EDIT);
lines below CHARS_PER_EDIT are linked with exact copies only. Classes are the connected components.
A class keeps its first line (smallest doc_id, then line number); blank lines are kept and not compared.

Join. A line of length l with threshold t is split evenly into t + 1 segments; whatever t edits do,
one segment stays whole. Each line indexes its segments under (l, segment number, contents) and
probes, for every length from its own down by at most t, the substrings that could be that segment: only the
start positions allowed by the multi-match-aware window are tried. Keys are hashes of substrings taken from
prefix sums, sorted and packed by target group in the task that reads the documents; equal lines count once in
a task, and the number of groups follows the number of lines. With each key travels a profile, the counts modulo 16 of 16 classes of code points: one edit moves it by
2 at most, so lines that share a segment by accident go no further. Candidates are verified on their whole texts with banded bit-parallel edit distance,
for all pairs of a batch at once.

Hot keys. A segment shared by more than HOT lines is not compared pair by pair. Its lines are dealt again by the join
itself: some shared segment of a linked pair has at most i edits before it and at most t - i after it (i: its number), so the longer
of the two sides is split into one segment more than its own edits allow, and the lines meet again only under equal
segments of that side; a side still shared by many is split once more, down to SHORTEST code points or LEVELS levels. A task that meets a
hot key on its own sends the lines to groups by line, not to the key's group, so no group holds a hot key whole.

Lines are told apart by 64-bit hashes of their contents (expected false merges: n**2 / 2**65 for n distinct lines).

Defined cases: a null text has no line, an empty one has one blank line; a null doc_id takes no part (deduplicate_lines keeps its row
as it is); rows that repeat a doc_id repeat its lines, and kept lines are kept in each; of equal lines the first by doc_id, then line
number, is kept; very long lines and texts are handled whole, a text being the smallest unit of work; an empty table gives no rows; other
columns are not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx
from streamlens.llm.graph import components
from streamlens.llm.store import materialize

MAX_EDITS = 2
CHARS_PER_EDIT = 20
#: Different lines under one key from which on the key is dealt again; the shortest side and the number of levels to which that goes.
HOT, SHORTEST, LEVELS = 1024, 8, 12
#: Entries that a task gathers before it sends them, and about as many as a group is meant to hold.
FLUSH, GROUP = 1 << 18, 1 << 19
#: Line hashes (8 bytes each) that select texts for verification are broadcast up to this number, else joined by shuffling.
BROADCAST_LINES = 1_000_000
_INDEX, _PROBE = 1, 2
#: Bits above an entry's code: it goes on to the next level as it is; its key is hot; its key is not dealt again.
_SPREAD, _MARK, _LAST = 1 << 15, 1 << 14, 1 << 13


class Lines:
    """The lines of a block: byte and code-point positions, document, number and content hash."""

    def __init__(self, column: pa.Array) -> None:
        self.data, offsets = tx.buffers(column)
        present = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
        feeds = np.flatnonzero(self.data == 10)
        start = np.concatenate([offsets[:-1][present], feeds + 1])
        doc = np.concatenate([np.flatnonzero(present), np.searchsorted(offsets, feeds, side="right") - 1])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        n = np.bincount(self.doc, minlength=len(column))
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        last = np.ones(len(self.doc), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.end = np.empty_like(self.start)
        self.end[:-1] = self.start[1:] - 1
        self.end[last] = offsets[1:][self.doc[last]]
        self.letters = np.flatnonzero((self.data & 0xC0) != 0x80)
        self.first = np.searchsorted(self.letters, self.start)
        self.length = np.searchsorted(self.letters, self.end) - self.first
        self.prefix = tx.rolling(self.data.astype(np.uint16) + 1)
        self.hash = tx.substring_hash(self.prefix, self.start, self.end)
        gap = np.concatenate([[0], np.cumsum(~tx._SEPARATOR[self.data])])
        self.blank = gap[self.end] == gap[self.start]

    def profiles(self) -> np.ndarray:
        """Per line, 16 counts modulo 16 of code points by the low bits of their last byte, in one word."""
        last = np.append(self.letters[1:], len(self.data)) - 1
        line = np.repeat(np.arange(len(self.first)), self.length)
        at = np.arange(len(line)) - np.repeat(np.cumsum(self.length) - self.length, self.length) + self.first[line]
        counts = np.bincount(line * 16 + (self.data[last[at]] & 15), minlength=16 * len(self.first)).reshape(-1, 16) & 15
        return (counts.astype(np.uint64) << (4 * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)

    def substring(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of code points first .. first + length."""
        stops = np.append(self.letters, len(self.data))
        return tx.substring_hash(self.prefix, stops[first], stops[first + length])


def segment(length: np.ndarray, parts: np.ndarray, i) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) when length is split evenly into parts; longer segments last."""
    short = length // parts
    longer = length - short * parts
    return i * short + np.maximum(0, i - (parts - longer)), short + (i >= parts - longer)


def _windows(base: np.ndarray, size: np.ndarray, edits: np.ndarray, i: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces of these sizes may hold segment i of a piece of size base, moved by shift: (allowed, start, length)."""
    begin, width = segment(np.maximum(base, 1), edits + 1, i)
    longer = size - base
    low, high = np.maximum(-i, longer - (edits - i)), np.minimum(i, longer + (edits - i))
    ok = (i <= edits) & (abs(longer) <= edits) & (low <= shift) & (shift <= high) & (begin + shift >= 0) & (begin + shift + width <= size)
    return ok, begin + shift, width


def _moves(max_edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of every probe; its place in the list is its code."""
    return [(d, i, s) for d in range(max_edits + 1) for i in range(max_edits + 1) for s in range(-max_edits, max_edits + 1)]


def keys(lines: Lines, chosen: np.ndarray, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, code) for the chosen lines: their indexed segments, and the substrings they probe. A code is 4 * the move's place + the role."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = lines.length[chosen]
    for code, (shorter, i, shift) in enumerate(_moves(max_edits)):
        target = size - shorter
        edits = np.minimum(max_edits, target // chars)
        ok, begin, width = _windows(target, size, edits, i, shift)
        ok &= edits >= 1
        k = chosen[ok]
        if len(k):
            h = lines.substring(lines.first[k] + begin[ok], width[ok])
            key = tx.mix(h + target[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
            role = _INDEX | _PROBE if shorter == 0 and shift == 0 else _PROBE
            out.append((key, k, np.full(len(k), 4 * code + role, np.uint16)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sides(size: np.ndarray, code: np.ndarray, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT) -> dict[str, np.ndarray]:
    """For entries of lines of these sizes: the side to compare next, as place and size in the line, size in the indexed line, and edits."""
    shorter, i, shift = np.array(_moves(max_edits), np.int64).reshape(-1, 3)[code >> 2].T
    base = size - shorter
    edits = np.minimum(max_edits, base // chars)
    begin, width = segment(np.maximum(base, 1), edits + 1, i)
    return _side(np.zeros(len(size), np.int64), size, base, edits, i, begin, width, shift)


def _side(start, size, base, edits, i, begin, width, shift) -> dict[str, np.ndarray]:
    right = base - begin - width >= begin
    after = begin + shift + width
    return {
        "start": np.where(right, start + after, start),
        "size": np.where(right, size - after, begin + shift),
        "base": np.where(right, base - begin - width, begin),
        "edits": np.where(right, edits - i, i),
    }


def next_keys(lines: Lines, key: np.ndarray, role: np.ndarray, side: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries one level down: row, key, role and their next side. Row r's side is a part of line r."""
    out: list[dict[str, np.ndarray]] = []
    most = int(side["edits"].max(initial=0))
    for i in range(most + 1):
        for shift in range(-i, i + 1):
            ok, begin, width = _windows(side["base"], side["size"], side["edits"], i, shift)
            r = np.flatnonzero(ok)
            if len(r):
                x = {k: v[r] for k, v in side.items()}
                h = lines.substring(lines.first[r] + x["start"] + begin[r], width[r])
                own = (role[r] & _INDEX > 0) & (shift == 0) & (x["size"] == x["base"])
                down = _side(x["start"], x["size"], x["base"], x["edits"], i, begin[r] - shift, width[r], shift)
                out.append({"row": r, "key": tx.mix(h + key[r] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(i)), "role": np.where(own, role[r], _PROBE).astype(np.uint16), **down})
    if not out:
        none = np.zeros(0, np.int64)
        return {"row": none, "key": none.astype(np.uint64), "role": none.astype(np.uint16), "start": none, "size": none, "base": none, "edits": none}
    return {k: np.concatenate([x[k] for x in out]) for k in out[0]}


def near_profiles(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """Whether the profiles can be those of lines within so many edits."""
    moved = np.zeros(len(x), np.int64)
    for b in range(0, 64, 4):
        d = ((x >> np.uint64(b)) - (y >> np.uint64(b))).astype(np.int64) & 15
        moved += np.minimum(d, 16 - d)
    return moved <= 2 * edits


def _selected(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, length, line (content hash) and blank of every line."""
    schema = "doc_id long, line_no int, length int, line long, blank boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                x = Lines(part.column("text"))
                columns = [part.column("doc_id").take(pa.array(x.doc)), pa.array(x.number.astype(np.int32)), pa.array(x.length.astype(np.int32)), pa.array(x.hash.view(np.int64)), pa.array(x.blank)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "length", "line", "blank"])

    return docs.mapInArrow(run, schema)


class _Seen:
    """Hashes met by a task, so that each line is handled once in it."""

    def __init__(self) -> None:
        self.all = np.zeros(0, np.uint64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Positions of the first occurrence of each hash that was not met before."""
        distinct, at = np.unique(h, return_index=True)
        place = np.searchsorted(self.all, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.all)
        known[inside] = self.all[place[inside]] == distinct[inside]
        self.all = np.insert(self.all, place[~known], distinct[~known])
        return at[~known]


#: What travels: groups of entries, each column one value of packed numbers. The last four are a hot key's sides below the first level.
_PACKED = {"key": np.uint64, "line": np.uint64, "profile": np.uint64, "code": np.uint16, "start": np.int32, "size": np.int32, "base": np.int32, "edits": np.uint8}
_PACKED_SCHEMA = "group int, " + ", ".join(f"{c} binary" for c in _PACKED)
#: Pairs (kind 0: a and b), and the entries of hot keys (kind 1: line a, key b).
_FOUND = "kind tinyint, a long, b long, profile long, code int, start int, size int, base int, edits int"


def _packed(entries: dict[str, np.ndarray], groups: int, hot: int) -> pa.RecordBatch:
    """Entries by group: ranges of keys; a key with more than hot lines leaves a mark in its group, and its entries go to groups by line."""
    order = np.argsort(entries["key"], kind="stable")
    e = {c: entries[c][order] for c in entries}
    new = np.ones(len(order), bool)
    new[1:] = e["key"][1:] != e["key"][:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    by = e["key"]
    many = (count > hot) & (e["code"][first] & _LAST == 0)
    if many.any():
        crowded = np.repeat(many, count)
        e["code"] = np.where(crowded, e["code"] | _SPREAD, e["code"]).astype(np.uint16)
        by = np.where(crowded, tx.mix(e["line"] + np.uint64(1)), e["key"])
        marks = first[many]
        by = np.concatenate([by, e["key"][marks]])
        e = {c: np.concatenate([e[c], np.full(len(marks), _MARK, np.uint16) if c == "code" else e[c][marks]]) for c in e}
        order = np.argsort(by, kind="stable")
        by, e = by[order], {c: e[c][order] for c in e}
    group = ((by >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(group)) + 1
    of = group[np.concatenate([[0], cut])].astype(np.int32)
    blobs = [pa.array([y.tobytes() for y in np.split(e[c].astype(t), cut)] if c in e else [b""] * len(of), pa.binary()) for c, t in _PACKED.items()]
    return pa.RecordBatch.from_arrays([pa.array(of), *blobs], names=["group", *_PACKED])


def _match(max_edits: int, hot: int):
    """The function of one group: its pairs, and the entries of its hot keys."""

    def match(table: pa.Table) -> pa.Table:
        e = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in _PACKED.items()}
        n = len(e["key"])
        e = {c: x if len(x) == n else np.zeros(n, x.dtype) for c, x in e.items()}
        spread = e["code"] & _SPREAD > 0
        passed = {c: x[spread] for c, x in e.items()}
        e = {c: x[~spread] for c, x in e.items()}
        order = np.lexsort((e["code"], e["line"], e["key"]))
        e = {c: x[order] for c, x in e.items()}
        key, line, profile, code = (e[c] for c in ("key", "line", "profile", "code"))
        # only keys with an index entry of one line and a probe of another can give a pair
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.append(np.flatnonzero(new), len(key))
        other = new.copy()
        other[1:] |= line[1:] != line[:-1]
        different = np.add.reduceat(other, begin[:-1]) if len(key) else np.zeros(0, np.int64)
        marked = np.maximum.reduceat(code & _MARK, begin[:-1]) > 0 if len(key) else np.zeros(0, bool)
        last = np.maximum.reduceat(code & _LAST, begin[:-1]) > 0 if len(key) else np.zeros(0, bool)
        crowded = ((different > hot) | marked) & ~last
        handed = np.repeat(crowded, np.diff(begin)) & (code & _MARK == 0)
        several = np.flatnonzero((different > 1) & ~crowded)
        found: list[np.ndarray] = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            keep = line[i] != line[j]
            i, j = i[keep], j[keep]
            keep = near_profiles(profile[i], profile[j], max_edits)
            a, b = line[i[keep]], line[j[keep]]
            pair = np.stack([np.minimum(a, b), np.maximum(a, b)])
            if pair.shape[1]:
                found.append(np.unique(pair, axis=1))

        role = code & 3
        small = several[np.diff(begin)[several] == 2]
        first = begin[small]
        hit = ((role[first] & _INDEX > 0) & (role[first + 1] & _PROBE > 0)) | ((role[first] & _PROBE > 0) & (role[first + 1] & _INDEX > 0))
        add(first[hit], first[hit] + 1)
        for g in several[np.diff(begin)[several] > 2].tolist():
            a, b = begin[g], begin[g + 1]
            once = np.ones(b - a, bool)  # a line that several tasks met, or that probes here twice, once
            once[1:] = (line[a + 1 : b] != line[a : b - 1]) | (role[a + 1 : b] != role[a : b - 1])
            index, probe = (a + np.flatnonzero(once & (role[a:b] & x > 0)) for x in (_INDEX, _PROBE))
            step = max(1, (1 << 18) // max(1, len(probe)))
            for i in range(0, len(index), step):
                part = index[i : i + step]
                add(np.repeat(part, len(probe)), np.tile(probe, len(part)))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.uint64)
        rest = {c: np.concatenate([passed[c], e[c][handed]]) for c in e}
        p, q = pairs.shape[1], len(rest["key"])
        columns = [np.repeat(np.array([0, 1], np.int8), [p, q]), np.concatenate([pairs[0], rest["line"]]).view(np.int64), np.concatenate([pairs[1], rest["key"]]).view(np.int64)]
        columns += [np.concatenate([np.zeros(p, np.uint64), rest["profile"]]).view(np.int64)]
        columns += [np.concatenate([np.zeros(p, np.int32), (rest[c] & (_LAST - 1) if c == "code" else rest[c]).astype(np.int32)]) for c in ("code", "start", "size", "base", "edits")]
        return pa.table([pa.array(x) for x in columns], names=[x.split()[0] for x in _FOUND.split(", ")])

    return match


def _group_number(spark, entries: int) -> int:
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // GROUP))


def found_keys(docs: DataFrame, groups: int, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT, hot: int = HOT) -> DataFrame:
    """The first level, from the documents: _FOUND rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = _Seen(), [], 0

        def packed() -> pa.RecordBatch:
            entries = {c: np.concatenate([x[i] for x in held]) for i, c in enumerate(("key", "line", "profile", "code"))}
            held.clear()
            return _packed(entries, groups, hot)

        for batch in batches:
            for part in tx.blocks(batch, "text"):
                x = Lines(part.column("text"))
                plain = np.flatnonzero(~x.blank & (x.length >= chars))
                key, line, code = keys(x, plain[seen.new(x.hash[plain])], max_edits, chars)
                if len(key):
                    held.append((key, x.hash[line], x.profiles()[line], code))
                    size += len(key)
                if size >= FLUSH:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return docs.mapInArrow(emit, _PACKED_SCHEMA).groupBy("group").applyInArrow(_match(max_edits, hot), _FOUND)


def dealt_again(entries: DataFrame, texts: DataFrame, groups: int, top: bool, deepest: bool, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT, hot: int = HOT) -> DataFrame:
    """One level further down: the entries of hot keys (_FOUND rows of kind 1), with their lines' texts, as _FOUND rows."""
    wide = entries.withColumnRenamed("a", "line").join(texts, "line").select("line", "b", "profile", "code", "start", "size", "base", "edits", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            entries = {c: np.concatenate([x[c] for x in held]) for c in _PACKED}
            held.clear()
            return _packed(entries, groups, hot)

        for batch in batches:
            for part in tx.blocks(batch, "text", tx.BLOCK_BYTES // 2):
                x = Lines(part.column("text"))
                line, key, profile, code = (part.column(c).to_numpy() for c in ("line", "b", "profile", "code"))
                if top:
                    side = sides(x.length.astype(np.int64), code.astype(np.int64), max_edits, chars)
                else:
                    side = {c: part.column(c).to_numpy().astype(np.int64) for c in ("start", "size", "base", "edits")}
                # a short side is dealt by nothing but its parent's key; so is one without room for its segments
                going = (side["base"] >= SHORTEST) & (side["base"] > side["edits"]) & (not deepest)
                stop = np.flatnonzero(~going)
                down = next_keys(x, key.view(np.uint64), code & 3, {c: np.where(going, v, -1 if c == "edits" else v) for c, v in side.items()})
                row = np.concatenate([down["row"], stop])
                if len(row):
                    held.append({
                        "key": np.concatenate([down["key"], key.view(np.uint64)[stop]]), "line": line.view(np.uint64)[row], "profile": profile.view(np.uint64)[row],
                        "code": np.concatenate([down["role"], (code[stop] & 3 | _LAST).astype(np.uint16)]), **{c: np.concatenate([down[c], side[c][stop]]) for c in ("start", "size", "base", "edits")},
                    })
                    size += len(row)
                if size >= FLUSH:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return wide.mapInArrow(emit, _PACKED_SCHEMA).groupBy("group").applyInArrow(_match(max_edits, hot), _FOUND)


def line_texts(docs: DataFrame) -> DataFrame:
    """line and text of every line that is not blank, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                x = Lines(part.column("text"))
                plain = np.flatnonzero(~x.blank)
                k = plain[seen.new(x.hash[plain])]
                raw = x.data.tobytes()
                texts = [raw[a:b] for a, b in zip(x.start[k].tolist(), x.end[k].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.hash[k].view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())], names=["line", "text"])

    return docs.mapInArrow(run, "line long, text string")


def within(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is at most its limit: banded bit-parallel, one column of all pairs at a time.

    The band of 2 * limit + 1 diagonals sits in the top bits of a word that moves down a row with
    each column; vertical differences are two bit vectors.
    """
    n = len(a)
    out = np.zeros(n, bool)
    if not n:
        return out
    k = int(limit.max())
    m1, m2 = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    swap = m1 < m2
    pattern, text = [y if s else x for x, y, s in zip(a, b, swap, strict=True)], [x if s else y for x, y, s in zip(a, b, swap, strict=True)]
    m, t = np.maximum(m1, m2), np.minimum(m1, m2)
    near = (m - t <= limit) & (m > 2 * k)
    for i in np.flatnonzero((m - t <= limit) & (m <= 2 * k)).tolist():
        out[i] = _distance(pattern[i], text[i]) <= limit[i]
    order = np.flatnonzero(near)
    order = order[np.argsort(m[order], kind="stable")]
    at = 0
    while at < len(order):
        # pairs of about equal length, a bounded number of cells
        to = at + 1
        while to < len(order) and (to + 1 - at) * m[order[to]] <= 1 << 21:
            to += 1
        rows = order[at:to]
        out[rows] = _banded([pattern[i] for i in rows.tolist()], [text[i] for i in rows.tolist()], m[rows], t[rows], limit[rows], k)
        at = to
    return out


def _distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def _banded(pattern: list[str], text: list[str], m: np.ndarray, t: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    def matrix(values: list[str], sizes: np.ndarray, before: int, after: int, fill: int) -> np.ndarray:
        flat = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
        x = np.full((before + int(sizes.max()) + after, len(values)), fill, np.uint32)
        row = np.repeat(np.arange(len(values)), sizes)
        x[before + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        return x

    columns = int(t.max())
    p = matrix(pattern, m, k, 2 * k + max(0, columns - int(m.max())) + 1, 0xFFFFFFFF)
    q = matrix(text, t, 0, 0, 0xFFFFFFFE)
    one, top = np.uint64(1), 63
    alive = np.arange(len(m))
    vp = np.full(len(m), ((1 << 64) - 1) ^ ((1 << (top - k)) - 1), np.uint64)
    vn = np.zeros(len(m), np.uint64)
    score = np.full(len(m), k, np.int64)
    final = np.full(len(m), 1 << 30, np.int64)
    for i in range(columns):
        letter = q[i, alive]
        eq = np.zeros(len(alive), np.uint64)
        for b in range(2 * k + 1):
            eq |= (p[i + b, alive] == letter).astype(np.uint64) << np.uint64(top - 2 * k + b)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        down = i < m[alive] - k
        across = np.uint64(top - 1) - np.maximum(0, i - (m[alive] - k)).astype(np.uint64)
        step = np.where(down, 1 - (d0 >> np.uint64(top)).astype(np.int64), ((hp >> across) & one).astype(np.int64) - ((hn >> across) & one).astype(np.int64))
        score = score + step
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
        done = i + 1 == t[alive]
        final[alive[done]] = score[done]
        # the score follows the lowest diagonal, then the last row: it can fall by at most k on each
        stay = ~done & (score <= limit[alive] + 2 * k)
        if not stay.all():
            alive, vp, vn, score = alive[stay], vp[stay], vn[stay], score[stay]
            if not len(alive):
                break
    return final <= limit


def candidates(docs: DataFrame, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT, hot: int = HOT, lines_: int = 0) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of line hashes that share a segment key, and the texts of all their lines, both written. lines_: about the number of lines."""
    spark = docs.sparkSession
    found = materialize(found_keys(docs, _group_number(spark, lines_ * (max_edits + 1) ** 2), max_edits, chars, hot), "line-keys")
    hot_ = found.where("kind = 1")
    more = hot_.count()
    pairs = found.where("kind = 0").select("a", "b")
    ids = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line")))
    ids = materialize(ids.unionByName(hot_.select(F.col("a").alias("line"))).distinct(), "line-ids")
    few = ids.count() <= BROADCAST_LINES
    texts = materialize(line_texts(docs).join(F.broadcast(ids) if few else ids, "line", "left_semi").dropDuplicates(["line"]), "line-texts")
    level = 1
    while more:
        found = materialize(dealt_again(hot_, texts, _group_number(spark, more * (max_edits + 1)), level == 1, level == LEVELS, max_edits, chars, hot), "line-keys")
        pairs = pairs.unionByName(found.where("kind = 0").select("a", "b"))
        hot_ = found.where("kind = 1")
        more, level = hot_.count(), level + 1
    return materialize(pairs.distinct(), "line-pairs"), texts


def links(docs: DataFrame, max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT, hot: int = HOT, lines_: int = 0) -> DataFrame:
    """All pairs a, b of different lines within the threshold, written."""
    pairs, texts = candidates(docs, max_edits, chars, hot, lines_)
    wide = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "ta", tx.BLOCK_BYTES // 2):
                a, b = part.column("ta").to_pylist(), part.column("tb").to_pylist()
                shorter = np.fromiter((min(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
                yield part.filter(pa.array(within(a, b, np.minimum(max_edits, shorter // chars)))).select(["a", "b"])

    return materialize(wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "line-links")


def line_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT, hot: int = HOT) -> DataFrame:
    """doc_id, line_no, length, class_doc_id and class_line_no (the class's first line), n_links (different lines within the threshold) and kept, for every line."""
    docs = _selected(docs, id_column, text_column)
    every = materialize(occurrences(docs), "lines")
    found = links(docs, max_edits, chars, hot, every.where((F.col("length") >= chars) & ~F.col("blank")).count())
    degree = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = materialize(components(found, "line-classes").join(degree, "node"), "line-roots")
    plain = every.where("NOT blank").join(linked, F.col("line") == F.col("node"), "left")
    plain = plain.select("doc_id", "line_no", "length", F.coalesce("root", "line").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    # Only classes of several lines need their first line looked up; written, so that adaptive execution can split the rows of a very common line.
    first = materialize(plain.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first"), "line-firsts")
    own = F.coalesce("first", F.struct("doc_id", "line_no"))
    plain = plain.join(first, "class", "left").select("doc_id", "line_no", "length", own["doc_id"].alias("class_doc_id"), own["line_no"].alias("class_line_no"), "n_links")
    blank = every.where("blank").select("doc_id", "line_no", "length", F.col("doc_id").alias("class_doc_id"), F.col("line_no").alias("class_line_no"), F.lit(0).cast("long").alias("n_links"))
    return plain.unionByName(blank).withColumn("kept", (F.col("doc_id") == F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no")))


def deduplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_edits: int = MAX_EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """docs with the lines that are not kept taken out of their texts; every row stays, also one left without text."""
    gone = line_classes(docs, id_column, text_column, max_edits, chars).where("NOT kept").select("doc_id", "line_no").distinct()
    gone = gone.groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of docs can clash with doc_id and gone
    rows = rows.join(gone, rows[names.index(id_column)].cast("long") == F.col("doc_id"), "left").drop("doc_id")
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone_ = batch.column(at).to_pylist(), batch.column("gone").to_pylist()
            for i, drop in enumerate(gone_):
                if drop and texts[i] is not None:
                    out = set(drop)
                    texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in out)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return rows.mapInArrow(run, schema).toDF(*names)
