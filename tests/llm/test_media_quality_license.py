import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from streamlens.llm import licenses, media, quality
from streamlens.llm import text as tx


def _wav(n: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(bytes(range(256)) * (n // 256 + 1))
    return out.getvalue()


def _png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello " * 50)
    return out.getvalue()


_GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
_JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xc0" + struct.pack(">H", 11) + bytes(9) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x12\xff\x00\x34\xff\xd9"
_PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
_AU = b".snd" + struct.pack(">IIIII", 24, 10, 2, 8000, 1) + bytes(10)
ITEMS = [("audio/wav", _wav(500)), ("image/png", _png()), ("application/zip", _zip()), ("image/gif", _GIF), ("image/jpeg", _JPEG), ("application/pdf", _PDF), ("audio/basic", _AU), ("image/bmp", media.store_payload(b"\0" * 64) if media.store_payload(b"\0" * 64)[:2] == b"BM" else media.store_payload(b"\1" + b"\0" * 63))]


def test_items_are_found_where_they_are():
    sniffer = media.Sniffer()
    for kind, item in ITEMS:
        if kind == "image/bmp" and item[:2] != b"BM":
            continue
        assert sniffer.items(item) == [(kind, 0, len(item))]
        assert sniffer.items(b"junk BM RIFF " + item + b" tail") == [(kind, 13, len(item))]
        assert sniffer.items(item[:-1]) == [] or kind == "application/zip"
    both = b"xx".join(x for _, x in ITEMS)
    found = sniffer.items(both)
    assert [k for k, _, _ in found] == [k for k, x in ITEMS] and all(both[a : a + n] == x for (_, a, n), (_, x) in zip(found, ITEMS, strict=True))


def test_sniff_corrects_types_and_carves(spark):
    rows = [(1, "image/png", _wav(300)), (2, "text/plain", b"see " + _png() + b"!"), (3, None, b""), (4, "text/plain", None), (5, "text/plain", b"BM no")]
    got = media.sniff(spark.createDataFrame(rows, "type long, declared string, value binary"), "value", "declared", ["type"]).toPandas()
    assert got.shape[0] == 5
    df = spark.createDataFrame(rows, "id long, declared string, value binary")
    got = {r.id: r for r in media.sniff(df, "value", "declared", ["id"]).collect()}
    assert got[1].corrected == "audio/wav" and bytes(got[1].media) == _wav(300)
    assert got[2].corrected == "text/plain" and got[2].type == "image/png" and got[2].offset == 4 and bytes(got[2].media) == _png()
    assert got[3].type is None and got[4].media is None and got[5].type is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300))
def test_stored_payloads_read_back(raw):
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    stored = media.store_payload(payload)
    (kind, at, n), *_ = media.Sniffer().items(stored)
    assert at == 0 and n == len(stored) and media.read_payload(stored, kind) == payload


def test_document_media(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 64), (5, "BM RIFF %PDF-1 %%EOF " * 40), (1, "héllo"), (None, "y" * 65)]
    got = media.document_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in got) == want
    for r in got:
        payload = (dict(rows)[r.doc_id] or "").encode().ljust(r.payload_bytes, b"\0")
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes % 64 == 0 and r.media_bytes > r.payload_bytes
    assert media.document_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _prose(rng, n):
    return " ".join("".join(rng.choice(["an", "th", "er", "ing", "on"]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def test_quality_learns_from_document_labels(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        lines = [_prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 4))]
        if not good:
            lines.insert(rng.randint(0, len(lines)), " | ".join(_prose(rng, 1) for _ in range(60)))
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    d = spark.createDataFrame(docs + [(9000, None), (9001, ""), (None, "the words"), (0, docs[0][1])], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(1, None)], "doc_id long, quality int")
    got = quality.score_documents(d, lab).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert [r.score for r in got] == [0.5]
    assert quality.score_documents(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def _bags(rng):
    n = np.array([3, 0, 6, 3, 9, 3, 0, 6, 12])
    return quality.Bags(rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9]), rng.integers(0, 40, n.sum()).astype(np.uint16), np.concatenate([[0], np.cumsum(n)]))


def test_attention_gradients():
    rng = np.random.default_rng(0)
    d, y = _bags(rng), np.array([1.0, 0.0, 1.0])
    m = quality.fit(d, y, epochs=1)
    m.p["e"] = m.p["e"].astype(float)  # for the differences below
    args = d.x, d.first, d.ids, d.start
    loss = lambda: -np.mean(y * np.log(m.forward(*args)["score"]) + (1 - y) * np.log(1 - m.forward(*args)["score"]))
    g = m.gradients(d.x, d.first, y, d.ids, d.start)
    for k, p in m.p.items():
        i = (int(d.ids[0]), 3) if k == "e" else tuple(rng.integers(0, s) for s in p.shape)
        p[i] += 1e-5
        up = loss()
        p[i] -= 2e-5
        down = loss()
        p[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6


def test_scores_match_a_plain_forward_pass():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Some", "words", "é", "x1", "THE", "ende."]) for _ in range(n)) for n in (0, 1, 47, 48, 49, 300)] + [None, "  "]
    column = pa.array(texts)
    d = quality.bags(column)
    m = quality.fit(d, np.array([1.0, 0, 1, 0, 1, 0, 1, 0]), epochs=2)
    got = m.forward(d.x, d.first, d.ids, d.start)["score"]
    p, sig = {k: v.astype(float) for k, v in m.p.items()}, lambda v: 1 / (1 + np.exp(-v))
    for i, t in enumerate(texts):
        words = [w for w in (t or "").split(" ") if w]
        rows = [words[a : a + 48] for a in range(0, max(1, len(words)), 48)]
        hidden = []
        for k, own in enumerate(rows):
            flat = [int(x) for w in own for x in quality.word_buckets(tx.words(pa.array([w])))[0]]
            mean = sum((p["e"][x] for x in flat), np.zeros(quality.HIDDEN)) / max(1, len(flat))
            hidden.append(np.tanh((d.x[d.first[i] + k] - m.mean) / m.scale @ p["w"] + mean + p["b"]))
        gate = np.array([(np.tanh(h @ p["v"]) * sig(h @ p["u"])) @ p["a"] for h in hidden])
        share = np.exp(gate) / np.exp(gate).sum()
        assert len(rows) == d.first[i + 1] - d.first[i] and abs(sig(sum(s * h for s, h in zip(share, hidden, strict=True)) @ p["c"] + p["d"][0]) - got[i]) < 1e-5


def test_licenses_match_brute_force():
    rng = random.Random(5)
    filler = lambda: _prose(rng, rng.randint(0, 90))
    texts = [filler() + " " + t + " " + filler() for _, _, t in licenses.TEMPLATES for _ in range(3)]
    texts += [filler() for _ in range(20)] + ["", "one two", "Released under the\nMIT   License"]
    damaged = licenses.TEMPLATES[2][2].split()
    del damaged[30]
    texts.append(filler() + " " + " ".join(damaged) + " " + filler())
    for body in [x for _, _, x in licenses.TEMPLATES if len(x.split()) > 12]:  # copies side by side, whole, broken off or with words left out
        words = body.split()
        part = lambda: words[: rng.choice([len(words), len(words), len(words) * 9 // 10, 6])]  # noqa: E731, B023
        texts.append(" ".join([*part(), *part(), *part(), *rng.choice([[], ["x"] * 5]), *part()]))
    scanner, got = licenses.Scanner(licenses.TEMPLATES), {}
    for d, t, a, b, _ in scanner.scan(*tx.buffers(pa.array(texts))):
        got.setdefault(d, []).append((*scanner.templates[t][:2], a, b + licenses.SHINGLE - 1))
    assert {i: sorted(f) for i, f in got.items()} == {i: f for i, f in enumerate(map(licenses.brute_force, texts)) if f}
    assert ("MIT", "grant") in {x[:2] for x in got[len(texts) - 1]} | {x[:2] for f in got.values() for x in f}


def test_neighbouring_copies_have_a_row_each(spark):
    grant = licenses.TEMPLATES[2][2]
    n = len(licenses.re.findall(r"[0-9A-Za-z]+", grant))
    df = spark.createDataFrame([(k, " ".join([grant] * k)) for k in (1, 2, 5)], "doc_id long, text string")
    got = licenses.scan_licenses(df).where("template = 'grant'").collect()
    assert sorted((r.doc_id, r.first_word, r.end_word) for r in got) == [(k, i * n, (i + 1) * n) for k in (1, 2, 5) for i in range(k)]


def test_license_scan_rows(spark):
    rows = [(1, "Hello. Licensed under the Apache License, Version 2.0."), (2, None), (None, "Released under the MIT License."), (1, "Hello. Licensed under the Apache License, Version 2.0."), (3, "")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.first_word, r.end_word, r.containment) for r in got) == [("1", "Apache-2.0", 1, 9, 1.0), ("1", "Apache-2.0", 1, 9, 1.0), ("None", "MIT", 0, 5, 1.0)]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_licenses_are_found_where_they_stand(spark, tmp_path):
    rng = random.Random(8)
    every = licenses.license_texts()
    assert {x for x, _, _ in every} >= {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "GPL-2.0"}
    rows, want = [], {}
    for i, (name, _, body) in enumerate(every):
        before, words = rng.randint(0, 400), len(licenses.re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", body))
        rows.append((i, " ".join(["vor"] * before) + "\n" + body.replace(" ", "\n\t") + "\nnach" * rng.randint(0, 200)))
        want[i] = (name, before, before + words)
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).where("template = 'text' AND containment = 1").collect()
    for i, x in want.items():
        assert x in [(r.license, r.first_word, r.end_word) for r in got if r.doc_id == i]
    assert {r.license for r in got if r.doc_id == [n for n, _, _ in every].index("BSD-3-Clause")} >= {"BSD-3-Clause"}
    assert {x[:2] for x in licenses.brute_force(rows[0][1], every)} == {(r.license, r.template) for r in licenses.scan_licenses(spark.createDataFrame(rows[:1], "doc_id long, text string"), templates=every).collect()}
    (tmp_path / "Own-1.0.txt").write_text("these are the terms of a license of our own making")
    assert licenses.read_templates(spark, str(tmp_path)) == [("Own-1.0", "text", "these are the terms of a license of our own making")]


def test_long_texts_ties_and_clashing_columns(spark):
    """One very long text, empty ones, a null id and repeated rows, beside columns named as the results are."""
    long = "Released under the MIT License. " + "lorem ipsum dolor, " * 60_000
    rows = [(1, long), (2, ""), (3, None), (None, "x y"), (1, long)]
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, score int, license string")
    none = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(str(r.doc_id) for r in quality.score_documents(df, none).collect()) == ["1", "1", "2", "3", "None"]
    assert [(r.doc_id, r.first_word) for r in licenses.scan_licenses(df).where("template = 'released'").collect()] == [(1, 0), (1, 0)]
    got = media.document_media(df.withColumn("feature", df.score)).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t in rows)
    for r in got:
        payload = np.frombuffer((dict(rows)[r.doc_id] or "").encode().ljust(r.payload_bytes, b"\0"), np.uint8)
        counts = np.bincount(payload, minlength=256)
        share = counts[counts > 0] / len(payload)
        assert r.feature == f"{r.media_type};n={len(payload)};mean={payload.mean():.4f};entropy={abs(-(share * np.log2(share)).sum()):.4f};bands={','.join(str(x) for x in counts.reshape(16, 16).sum(1))}"
