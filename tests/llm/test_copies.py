import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from streamlens.llm import graph, lines, neardup, repeats
from streamlens.llm import text as tx

DOCS = "doc_id long, text string"


class _Union:
    def __init__(self, items):
        self.p = {i: i for i in items}

    def find(self, a):
        while self.p[a] != a:
            a = self.p[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    u = _Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# lines


def _mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, c = rng.choice("idr"), rng.choice("abcdé")
        p = rng.randrange(len(s) + 1) if k == "i" else rng.randrange(len(s))
        s[p : p + (k != "i")] = [] if k == "d" else [c]
    return "".join(s)


def test_banded_distance_matches_plain():
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 70)))
        pairs.append((a, _mutate(rng, a, rng.randint(0, min(4, len(a) - 1)))))
    limit = np.array([rng.choice([1, 2, 3]) for _ in pairs])
    a, b = map(list, zip(*pairs, strict=True))
    assert lines.within(a, b, limit).tolist() == [lines._distance(x, y) <= k for x, y, k in zip(a, b, limit, strict=True)]


def _line_rows(seed, longest=70):
    rng = random.Random(seed)
    rows = []
    for d in range(50):
        own = []
        for _ in range(rng.randint(0, 8)):
            old = rng.choice(rng.choice(rows)[1].split("\n")) if rows and rng.random() < 0.6 else ""
            own.append(_mutate(rng, old, rng.randint(0, 3 if longest <= 70 else min(10, len(old) // 3))) if old else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, longest))))
        rows.append((d, "\n".join(own)))
    return rows


def _line_brute(rows, most=2):
    occ = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n"))]
    distinct = sorted({x for _, _, x in occ if x.strip()})
    u, degree, first = _Union(distinct), Counter(), {}
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            k = min(most, min(len(x), len(y)) // 20)
            if k and abs(len(x) - len(y)) <= k and (Counter(x) - Counter(y)).total() <= k and lines._distance(x, y) <= k:
                u.join(x, y)
                degree[x] += 1
                degree[y] += 1
    for d, i, x in sorted(occ):
        if x.strip():
            first.setdefault(u.find(x), (d, i))
    return sorted((d, i, len(x), *(first[u.find(x)] if x.strip() else (d, i)), degree[x] if x.strip() else 0) for d, i, x in occ)


def _line_result(df, **options):
    return sorted((r.doc_id, r.line_no, r.length, r.class_doc_id, r.class_line_no, r.n_links) for r in lines.line_classes(df, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_line_classes_match_brute_force(spark, seed):
    rows = _line_rows(seed)
    df = spark.createDataFrame([*rows, (100, None), (None, "x" * 30)], DOCS).repartition(3)
    assert _line_result(df) == _line_brute(rows)


def test_lines_of_several_hundred_letters_with_more_edits(spark):
    rows = _line_rows(5, 400)
    assert _line_result(spark.createDataFrame(rows, DOCS).repartition(3), max_edits=8) == _line_brute(rows, 8)


@pytest.mark.parametrize("hot,most", [(2, 2), (4, 4)])
def test_hot_segments_lose_no_link(spark, hot, most):
    rng = random.Random(hot)
    letters = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    fixed = [letters(40), letters(25)]
    own = [rng.choice(fixed) + letters(rng.randint(20, 40)) + rng.choice(["", fixed[1]]) for _ in range(60)] + [fixed[0] + " %03d" % i for i in range(25)]
    own += [_mutate(rng, rng.choice(own), rng.randint(1, most + 1)) for _ in range(80)]
    rows = [(d, "\n".join(own[d::20])) for d in range(20)]
    assert _line_result(spark.createDataFrame(rows, DOCS).repartition(3), max_edits=most, hot=hot) == _line_brute(rows, most)


def test_line_stage_keeps_first_lines(spark):
    long = "this line is long enough to be compared by edits"
    rows = [(2, f"{long}\nshort\n\nshort"), (1, f"{long}!\nfirst\n"), (3, None), (None, long), (4, ""), (5, "z" * 200_000), (1, f"{long}!\nfirst\n")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], DOCS + ", line_no string")
    got = lines.deduplicate_lines(df)
    assert got.columns == df.columns
    out = sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in got.collect() if r.text is not None)
    assert [t for _, t in out] == [f"{long}!\nfirst\n", f"{long}!\nfirst\n", "short\n", "", "z" * 200_000, long]
    assert got.where("text IS NULL").count() == 1
    assert lines.line_classes(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, long, "a", 5, "g"), (2, long + "?", "b", 6, "h"), (None, None, None, None, None)], DOCS + ", __doc string, gone int, c1 string")
    assert sorted(map(str, lines.deduplicate_lines(clash).collect())) == sorted(map(str, [clash.first(), *[r for r in clash.selectExpr("doc_id", "if(doc_id = 2, '', text) AS text", "__doc", "gone", "c1").collect() if r.doc_id != 1]]))
    assert lines.deduplicate_lines(spark.createDataFrame([], clash.schema)).columns == clash.columns


# substrings


def _repeat_brute(rows, n=20):
    w = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, out = {}, {}
    for i in sorted(w):
        for p in range(len(w[i]) - n + 1):
            first.setdefault(tuple(w[i][p : p + n]), (i, p))
    for i, own in w.items():
        gone = [False] * len(own)
        for p in range(len(own) - n + 1):
            if first[tuple(own[p : p + n])] < (i, p):
                gone[p : p + n] = [True] * n
        kept = [x for x, g in zip(own, gone, strict=True) if not g]
        out[i] = (len(own), sum(gone), " ".join(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def _repeat_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        if rows and rng.random() < 0.7:
            x = rng.choice(rows)[1].split()
            a = rng.randint(0, len(x))
            w[len(w) // 2 : len(w) // 2] = x[a : a + rng.randint(10, 40)]
        if rng.random() < 0.2:
            w = w * 3
        if rng.random() < 0.1:
            w = ["é"] * rng.randint(15, 70)
        rows.append((i * 3 % 121, rng.choice([" ", "\n", "  \t"]).join(w)))
    return rows


def test_subtree_nodes_are_the_repeats():
    rng = np.random.default_rng(4)
    sizes = rng.integers(3, 20, 60)
    h = rng.integers(0, 2, sizes.sum()).astype(np.uint64)
    last = np.repeat(np.cumsum(sizes), sizes)
    suffixes = rng.permutation(np.flatnonzero(last - np.arange(len(h)) >= 5))
    order, node, depths = repeats.subtree(h, last, suffixes, 5)
    texts = [tuple(h[p : last[p]].tolist()) for p in order]
    assert texts == sorted(texts) and sorted(order) == sorted(suffixes)
    by = defaultdict(set)
    for k, t in zip(node, texts, strict=True):
        by[k].add(t)
    starts = {k: {t[:5] for t in ts} for k, ts in by.items()}
    assert all(len(x) == 1 for x in starts.values()) and len(starts) == len({t[:5] for t in texts})
    for k, ts in by.items():
        common = max(n for n in range(1, 21) if len({t[:n] for t in ts}) == 1 and min(map(len, ts)) >= n)
        assert depths[k] == common


@pytest.mark.parametrize("seed,heavy", [(1, 4096), (2, 3)])
def test_repeats_match_brute_force(spark, seed, heavy):
    rows = [*_repeat_rows(seed), (500, None), (501, ""), (502, " \n")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS + ", n_words int").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in repeats.remove_repeats(df, heavy=heavy).collect()}
    assert got == _repeat_brute(rows)


def test_repeats_of_null_ids_and_repeated_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(7, passage), (7, passage), (9, passage + " end"), (None, passage)]
    got = Counter((r.doc_id, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(7, 0): 2, (9, 30): 1, (None, 0): 1})
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


# near duplicates


def test_dart_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a = {i: int(c) for i, c in enumerate(rng.integers(1, 4, 300))}
    b = dict(a)
    for i in range(40):
        b[i + 1000] = b.pop(i)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    element = np.array([*a, *b], np.uint64)
    doc, w = np.repeat([0, 1], [len(a), len(b)]), np.array([*a.values(), *b.values()], float)
    shares = []
    for t in range(30):
        s = neardup.dart_minhash(doc, tx.mix(element + np.uint64(7919 * t + 1)), w, 3)
        shares.append((s[0] == s[1]).mean())
        assert (s[2] == 0).all()
    assert abs(np.mean(shares) - true) < 0.02
    part = [(lambda s: (s[0] == s[1]).mean())(neardup.dart_minhash(np.array([0, 1]), tx.mix(np.array([5, 5], np.uint64) + np.uint64(t)), np.array([0.7, 1.0]), 2)) for t in range(30)]
    assert abs(np.mean(part) - 0.7) < 0.03


def _near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "th", "er", "ing", "on", "st"]) for _ in range(3))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    return [*rows, (900, "a"), (901, "a"), (902, "a b c"), (903, ""), (904, None), (905, "a  a")]


def _near_brute(rows):
    def grams(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    g = [(i, grams(t)) for i, t in rows]
    u = _Union([i for i, _ in rows])
    for x, (i, a) in enumerate(g):
        for j, b in g[:x]:
            both = sum((a & b).values())
            total = sum(a.values()) + sum(b.values()) - both
            if not total or both / total >= 0.8:
                u.join(i, j)
    return {i: u.find(i) for i, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_classes_match_brute_force(spark, seed):
    rows = _near_rows(seed)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == _near_brute(rows)


def test_prefix_pairs_lose_nothing(spark):
    rows = _near_rows(3)[:40]
    docs = spark.createDataFrame(rows, DOCS)
    every = docs.selectExpr("doc_id", "doc_id AS class")
    got = {(r.a, r.b) for r in neardup.prefix_pairs(docs, every).collect()}
    texts = [t for _, t in rows]
    for x, (i, a) in enumerate(rows):
        near = neardup.weighted_jaccard(pa.array([a] * len(texts)), pa.array(texts)) >= 0.8
        assert all((min(i, rows[y][0]), max(i, rows[y][0])) in got for y in np.flatnonzero(near) if y != x)


def test_near_duplicate_stage(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, "x"), (1, text + " more", "y"), (1, text + " more", "y"), (2, "other text entirely here now", "z"), (None, text, "n"), (5, None, "e"), (6, "", "e")]
    df = spark.createDataFrame(rows, DOCS + ", weight string")
    got = neardup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.weight) for r in got.collect()) == [("1", "y"), ("2", "z"), ("5", "e"), ("None", "n")]
    assert neardup.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_of_rows_with_one_id_the_smallest_digest_stays(spark):
    rows = [(1, "one text about ships and harbours and tides"), (1, "another text on bread and salt and ovens"), (1, None), (2, "a third text of its own that nobody copies")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {(1, min((t for i, t in rows if i == 1), key=digest)), (2, rows[3][1])}
    for parts in (1, 4):
        assert {(r.doc_id, r.text) for r in neardup.deduplicate(df.repartition(parts)).collect()} == want
