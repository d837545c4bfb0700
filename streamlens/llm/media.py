"""Media columns: find, check, correct and carve media by their signatures.

An Aho-Corasick automaton finds all magic bytes of a value in one pass. At each hit the format's
validator walks the structure (chunks, segments, directories, checksums) and gives the
item's exact length, or refuses the hit. Items are taken from left to right and never overlap, so
magic bytes inside an item are its own content. The type of the first item at offset 0
corrects the declared type; items elsewhere are carved as embedded media.

Everything is done value by value in the tasks that read the rows: no shuffle.

Defined cases: a null or empty value has no item and keeps its declared type; a null declared
type is corrected like a wrong one; truncated or damaged media are not items; of formats that match at one
offset the first of FORMATS that its validator confirms is taken; very long values are handled whole; repeated
rows are handled each for itself; an empty table gives no rows; columns that are not carried are not looked at and may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx

Validator = Callable[[bytes, int], int]


def _riff(b: bytes, at: int) -> int:
    """RIFF/WAVE: length of the file, or 0. Needs a format chunk before the samples."""
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, size = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > end or (name == b"data" and b"fmt " not in seen) or (name == b"fmt " and size < 16):
            return 0
        seen.add(name)
        p += 8 + size + size % 2
    return end - at if {b"fmt ", b"data"} <= seen else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) - at < 54:
        return 0
    size, reserved, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or start < 14 + header or at + size > len(b):
        return 0
    if packed == 0 and start + (width * bits + 31) // 32 * 4 * abs(height) != size:
        return 0
    return size if size > start else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + size > len(b) or first and name != b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) - at < 14:
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def subblocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else 0
        if b[p] == 0x21:
            p = subblocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p, images = subblocks(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)), images + 1
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frames = at + 2, 0
    while p + 2 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xD9:
            return p + 2 - at if frames else 0
        if marker == 0xFF:
            p += 1
            continue
        if p + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or marker < 0xC0:
            return 0
        frames += 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if marker == 0xDA:  # entropy-coded data: up to the next marker that is neither stuffing nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit():
        return 0
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else 0


def _zip(b: bytes, at: int) -> int:
    p = at
    while (p := b.find(b"PK\x05\x06", p + 1)) > 0 and p + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, p + 12)
        if at + start + size == p and p + 22 + note <= len(b) and b[at + start : at + start + 4] == b"PK\x01\x02":
            return p + 22 + note - at
    return 0


def _au(b: bytes, at: int) -> int:
    if len(b) - at < 24:
        return 0
    start, size, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return start + size if 24 <= start and 1 <= code <= 27 and rate and 1 <= channels <= 256 and at + start + size <= len(b) else 0


#: Magic bytes, the type they announce and the validator that confirms it (fixed values of the formats).
FORMATS: list[tuple[bytes, str, Validator]] = [
    (b"RIFF", "audio/wav", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b".snd", "audio/basic", _au),
]


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            self._automaton.add_word(magic.decode("latin-1"), k)
        self._automaton.make_automaton()

    def items(self, value: bytes) -> list[tuple[str, int, int]]:
        """(type, offset, length) of the items, from left to right."""
        found, free = [], 0
        hits = sorted((end + 1 - len(FORMATS[k][0]), k) for end, k in self._automaton.iter(value.decode("latin-1")))
        for at, k in hits:
            if at >= free and (n := FORMATS[k][2](value, at)):
                found.append((FORMATS[k][1], at, n))
                free = at + n
        return found


def sniff(df: DataFrame, value_column: str, declared_column: str, carry: list[str]) -> DataFrame:
    """One row per item: the carried columns, declared, corrected (type of the whole value), type, offset, length and media.

    A value without any item gives one row with null type, offset, length and media.
    """
    kept = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(declared_column).alias("declared"), F.col(value_column).alias("value"))
    kinds = [f.dataType.simpleString() for f in kept.schema.fields[: len(carry)]]
    schema = ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "declared string", "corrected string", "type string", "offset long", "length long", "media binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            for part in tx.blocks(batch, "value"):
                row, items, corrected = [], [], []
                declared = part.column("declared").to_pylist()
                for i, value in enumerate(part.column("value")):
                    value = value.as_py() or b""
                    found = sniffer.items(value)
                    whole = found[0][0] if found and found[0][1] == 0 else declared[i]
                    for kind, at, n in found or [(None, None, None)]:
                        row.append(i)
                        corrected.append(whole)
                        items.append((kind, at, n, value[at : at + n] if n else None))
                kind, at, n, media = zip(*items, strict=True)
                at_row = pa.array(row, pa.int64())
                columns = [c.take(at_row) for c in part.columns[: len(carry) + 1]]
                columns += [pa.array(corrected, pa.string()), pa.array(kind, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.rsplit(" ", 1)[0] for x in schema.split(", ")])

    found = kept.mapInArrow(run, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "declared", "corrected", "type", "offset", "length", "media")


UNIT = 64


def store_payload(payload: bytes) -> bytes:
    """8-bit samples in one of two containers, chosen by the payload's own checksum: a mono WAV file or a grey BMP of 64 samples a row."""
    n = len(payload)
    if zlib.crc32(payload) & 1:
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
    palette = np.repeat(np.arange(256, dtype="<u4") * 0x010101, 1).tobytes()
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + n, 0, 1078, 40, UNIT, -(n // UNIT), 1, 8, 0, n, 2835, 2835, 256, 0) + palette + payload


def read_payload(media: bytes, kind: str) -> bytes:
    """The samples of a stored item, found through its own header."""
    if kind == "audio/wav":
        p = 12
        while media[p : p + 4] != b"data":
            size = struct.unpack_from("<I", media, p + 4)[0]
            p += 8 + size + size % 2
        return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    raise ValueError(f"no reader for {kind}")


def store_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared and value: each text's padded bytes in a media container, declared only as a stream of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "text"):
                data, offset = tx.buffers(part.column("text"))
                raw = data.tobytes()
                values = []
                for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
                    n = max(UNIT, -(-(b - a) // UNIT) * UNIT)
                    values.append(store_payload(raw[a:b].ljust(n, b"\0")))
                columns = [part.column("doc_id"), pa.array(np.diff(offset)), pa.array(["application/octet-stream"] * len(values)), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "declared", "value"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, declared string, value binary")


def features(items: DataFrame) -> DataFrame:
    """Digests and sample statistics of carved items with columns doc_id, n_bytes, type and media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "media"):
                out = []
                for kind, media in zip(part.column("type").to_pylist(), part.column("media"), strict=True):
                    media = media.as_py()
                    payload = read_payload(media, kind)
                    samples = np.frombuffer(payload, np.uint8)
                    counts = np.bincount(samples, minlength=256)
                    share = counts[counts > 0] / len(samples)
                    mean = float(counts @ np.arange(256)) / len(samples)
                    bands = ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))
                    said = f"{kind};n={len(samples)};mean={mean:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};bands={bands}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), said, kind))
                columns = [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c) for c in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return items.select("doc_id", "n_bytes", "type", "media").mapInArrow(run, schema)


def document_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store every text as media of undeclared type, sniff and carve it, read it back and describe it.

    The carved item is the stored value itself, found again by its structure; the value
    starts with it, so the first item is the one that was stored.
    """
    stored = store_documents(docs, id_column, text_column)
    items = sniff(stored, "value", "declared", ["doc_id", "n_bytes"])
    return features(items.where("offset = 0"))
