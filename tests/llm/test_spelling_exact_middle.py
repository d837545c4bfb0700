"""Operators 11 to 13 against brute force: spelling variants, exact duplicates, fill-in-middle."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from streamlens.llm import exact, middle, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "lang string, row long, digest string, word string, n long, block string"


def brute_words(rows, noise):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if noise and drawn % noise == 0:
                word = word[: drawn % len(word)] + word[drawn % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def word_rows(seed, documents=60):
    draw = random.Random(seed)
    rows = []
    for k in range(documents):
        alphabet = "ab" if draw.random() < 0.7 else "abzéÿÀ×"
        words = ["".join(draw.choice(alphabet) for _ in range(draw.choice([3, 4, 5, 5, 6, 6, 7, 9, 14]))) for _ in range(draw.randint(0, 80))]
        rows.append((None if k % 9 == 0 else k, draw.choice([" ", ". ", "\n", "1"]).join(words)))
    long = [(900, ("x" * 400 + " ") * 4 + ("x" * 399 + " ") * 9 + ("x" * 200 + "y" + "x" * 199 + " ") * 3)]
    return [*rows, *rows[:4], (901, None), (902, ""), (903, "THETA Theta theta théta " * 5), *long]


@pytest.mark.parametrize("block, noise", [(3, 97), (64, None)])
def test_spelling_variants_equal_brute_force(spark, block, noise):
    rows = word_rows(block)
    docs = spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"doc_id long, text string, {CLASHING}").repartition(3)
    got = spelling.variants(spelling.count_words(docs, noise=noise), block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed))
    assert set(listed) == brute_variants(brute_words(rows, noise))


def test_near_pairs_come_once_and_hot_blocks_are_subdivided(spark):
    words = ["aaaaa" + x + y for x in "bcdefghijk" for y in "lmnopqrstu"]
    frame = spark.createDataFrame([(w, 5, len(w)) for w in words], "word string, n long, length int")
    pairs = [tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(frame, block=8).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_apart(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_checksums_equal_zlib():
    draw = random.Random(3)
    parts = [bytes(draw.randrange(256) for _ in range(n)) for n in [1, 2, 63, 64, 65, 200, 0, 7]]
    offsets = np.cumsum([0, *map(len, parts)])
    begun = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(parts))], np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(parts), np.uint8), offsets, begun)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + p) for k, p in enumerate(parts)]


def test_spelling_of_empty_tables_and_chains(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    text = "abcdefghij " * 40 + "abcdefghi " * 20 + "abcdefgh " * 10 + "abcdefg " * 5
    got = {r.word: r.root for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert set(got.values()) == {"abcdefghij"}


def exact_rows():
    rows = [(1, "A b"), (2, "a b"), (None, "A B"), (2, "a b"), (3, None), (4, ""), (5, "É"), (6, "é"), (9, "z" * 100_000), (10, "Z" * 100_000)]
    return rows + [(100 + k, "Hot") for k in range(400)] + [(1000 + k, f"text {k % 90}") for k in range(300)]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        for k, x in enumerate(sorted(ids, key=lambda v: (v is None, -(v or 0)))):
            out[x, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("share", [1e-3, 0.05, 0.5])
def test_duplicate_groups_equal_brute_force(spark, share):
    rows = exact_rows()
    docs = spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"doc_id long, text string, {CLASHING}").repartition(5)
    assert Counter(tuple(r) for r in exact.duplicate_groups(docs, share=share).collect()) == brute_exact(rows)
    kept = exact.deduplicate(docs, share=share)
    assert kept.columns == docs.columns
    want = Counter({(k[0], k[4]): n for k, n in brute_exact(rows).items() if k[3]})
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").translate(UPPER).encode()).hexdigest()) for r in kept.collect()) == want


def test_heavy_digests_are_found_and_few_are_broadcast(spark):
    rows = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN concat('w', id % 7) ELSE concat('k', id) END AS key", "id")
    found = {r.key for r in exact.frequent(rows.repartition(16), "key", share=0.002).collect()}
    assert {"hot", *(f"w{k}" for k in range(7))} <= found and len(found) <= 1000
    with pytest.raises(ValueError):
        exact.frequent(rows, "key", share=1e-6)


def test_exact_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicate_groups(docs).count() == 0 and exact.deduplicate(docs).count() == 0


def middle_rows():
    rows = [(1, ""), (2, None), (3, "a\nb\nc"), (4, "\n\n\n"), (5, "x<P>y"), (None, "é\nü\n\x00nul\nq"), (7, "\U0001f600\r\nb c\n<"), (8, "a" * 50_000 + "\n" + "b\n" * 20_000), (9, "one line"), (10, "<\n<S\n>")]
    return rows + [(k, "l1\nl2 é\nl3 <\nl4<M") for k in range(11, 60)] + [(3, "a\nb\nc")]


def brute_middle(doc_id, text, seed, rate, spm):
    text = text or ""
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
    output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, len(lines), form, *sizes, output, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("seed, rate, spm", [(7, 100, 50), (1, 60, 0), (2, 100, 100), (3, 0, 50)])
def test_fill_in_middle_equals_brute_force(spark, seed, rate, spm):
    rows = middle_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, output string").repartition(3)
    got = Counter(tuple(r) for r in middle.fill_in_middle(docs, seed=seed, rate=rate, spm=spm).collect())
    assert got == Counter(brute_middle(*r, seed, rate, spm) for r in rows)


def test_fill_in_middle_of_an_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        middle.statement("t", rate=101)
