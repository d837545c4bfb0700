"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are SHINGLE consecutive words. Every
template belongs to the scale j with 2**(j-1) < its number of distinct shingles <= 2**j. At
scale j a text's shingles are cut into blocks of 2**j, and each two neighbouring blocks are a
window: windows overlap by half, and a template's occurrence lies inside one window or, when words were
added, at most spills into the next. A contained template with at least 0.8 of its shingles in
the window has a Jaccard similarity of at least 0.8 / 4.2 with it, so with BANDS bands of one
row a window misses it with probability below (1 - 0.19) ** 64 < 2e-6. A block's MinHashes come
from those of its halves, so all scales together cost twice the first.

Candidates are verified on their windows widened by half a block on both sides, overlapping ones together. An occurrence is the
first stretch that holds at least CONTAINMENT of the template's distinct shingles, lengthened by those further on in the template that follow about as soon as there (at most twice as
far and SLACK more) and by what follows word by word as there, and shortened from its left end by those that stand before the place where the template would begin and occur again; the next one is looked for behind its end. Every occurrence is a row.

Templates are a parameter of bounded size, sent with the code: by default short notices and the whole texts in the folder license_texts;
read_templates() takes more from a folder of one text file a license. Texts are read and matched in place: no shuffle.

Defined cases: null, empty and very short texts have no match; very long texts are matched whole; repeated rows are matched each for
itself; a null doc_id is carried; a place that matches several templates has a row for each; an empty table gives no rows; other columns are
not looked at and may have any name; templates of fewer words than a shingle are refused.
"""

from __future__ import annotations

import re
from collections import defaultdict
from importlib import resources
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.llm import text as tx

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
#: Shingles by which the rest of an occurrence may come later than twice as far as in the template.
SLACK = 8

#: Notices as their publishers word them (license, name of the notice, text).
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "released", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "spdx", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
]

#: The largest folder of templates that read_templates() takes, in bytes: templates go to every task with the code.
MAX_TEMPLATE_BYTES = 16 << 20


def license_texts() -> list[tuple[str, str, str]]:
    """The whole license texts that come with the package (fixed values): one file a license, named by its SPDX identifier."""
    folder = resources.files("streamlens.llm").joinpath("license_texts")
    return [(f.name.removesuffix(".txt"), "text", f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """Templates from a folder of text files in any store that Spark reads; a file's name is the license's."""
    files = spark.read.format("binaryFile").load(folder)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates in {folder}, more than {MAX_TEMPLATE_BYTES}")
    return sorted((r.path.rsplit("/", 1)[-1].removesuffix(".txt"), "text", bytes(r.content).decode("utf-8", "replace")) for r in files.select("path", "content").collect())


#: Bytes of letters and digits; all others separate. Letters outside ASCII count by their bytes.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACED = np.where(_WORD_BYTE, _LOWER, 0x20).astype(np.uint8)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and each text's first shingle."""
    w = tx.words_of(_SPACED[data], offsets)
    n = np.maximum(w.counts - SHINGLE + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    return tx.window_hash(tx.rolling(w.hashes()), at, SHINGLE), first


class Scanner:
    """Templates by scale, with their shingles and their MinHashes."""

    def __init__(self, templates=None, bands: int = BANDS, containment: float = CONTAINMENT) -> None:
        self.templates = list(TEMPLATES + license_texts() if templates is None else templates)
        self.containment = containment
        self.salts = tx.mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.sets: list[np.ndarray] = []
        self.orders: list[np.ndarray] = []  # of each shingle of the set, its first place in the template
        self.firsts: list[list[int]] = []  # the template itself, as the first places of its shingles
        by_scale: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, (_, _, text) in enumerate(self.templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            own, place, number = np.unique(shingles(raw, np.array([0, len(raw)]))[0], return_index=True, return_inverse=True)
            if not len(own):
                raise ValueError(f"template {t} has fewer than {SHINGLE} words")
            self.sets.append(own)
            self.orders.append(place)
            self.firsts.append(place[number].tolist())
            scale = (len(own) - 1).bit_length()
            for band, value in enumerate((own[:, None] * self.salts).min(0).tolist()):
                by_scale[scale][band, value].append(t)
        self.bands = {j: [np.array(sorted(v for b, v in keys if b == band), np.uint64) for band in range(bands)] for j, keys in by_scale.items()}
        self.owners = by_scale

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first shingle, end, share) of every match, shingles counted in their text."""
        h, first = shingles(data, offsets)
        top = max(self.bands, default=-1)
        candidates: set[tuple[int, int, int, int]] = set()
        size = np.diff(first)
        # blocks of scale 0 are single shingles; begin: the first block of each text
        count, begin = size.copy(), first.copy()
        mins = [h * s for s in self.salts] if len(h) else []
        for j in range(top + 1):
            if j and len(h):
                # two neighbouring blocks of a text become one; an odd last block stays alone
                count2 = -(-count // 2)
                begin2 = np.concatenate([[0], np.cumsum(count2)])
                left = np.repeat(begin[:-1] - 2 * begin2[:-1], count2) + 2 * np.arange(begin2[-1])
                right = np.minimum(left + 1, np.repeat(begin[1:] - 1, count2))
                mins = [np.minimum(m[left], m[right]) for m in mins]
                count, begin = count2, begin2
            if j not in self.bands or not len(h):
                continue
            text = np.repeat(np.arange(len(count)), count)
            following = np.minimum(np.arange(begin[-1]) + 1, begin[1:][text] - 1)
            for band, keys in enumerate(self.bands[j]):
                window = np.minimum(mins[band], mins[band][following])
                hit = np.flatnonzero(np.isin(window, keys))
                for b, value in zip(hit.tolist(), window[hit].tolist(), strict=True):
                    d = int(text[b])
                    for t in self.owners[j][band, value]:
                        candidates.add((d, t, b - int(begin[d]), j))
        return self._verify(h, first, candidates)

    def _verify(self, h: np.ndarray, first: np.ndarray, candidates) -> list[tuple[int, int, int, int, float]]:
        regions: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
        for d, t, a, b in sorted((d, t, max(0, (block << j) - (1 << j >> 1)), min(int(first[d + 1] - first[d]), ((block + 2) << j) + (1 << j >> 1))) for d, t, block, j in candidates):
            same = regions[d, t]
            if same and a <= same[-1][1]:
                same[-1][1] = max(same[-1][1], b)
            else:
                same.append([a, b])
        out = []
        for (d, t), spans in sorted(regions.items()):
            for a, b in spans:
                own = h[first[d] + a : first[d] + b]
                place = np.searchsorted(self.sets[t], own)
                at = np.flatnonzero(self.sets[t][np.minimum(place, len(self.sets[t]) - 1)] == own)
                for i, j, share in occurrences(at.tolist(), self.orders[t][place[at]].tolist(), self.firsts[t], len(self.sets[t]), self.containment):
                    out.append((d, t, a + int(at[i]), a + int(at[j]) + 1, share))
        return out


def occurrences(at: list[int], order: list[int], template: list[int], size: int, containment: float = CONTAINMENT) -> Iterator[tuple[int, int, float]]:
    """(first, last, share) of the occurrences among a text's template shingles, given by their places in the text and their first places in the template (itself given so; size distinct ones)."""
    need, begin, end = int(np.ceil(containment * size - 1e-9)), 0, 0
    seen: dict[int, int] = defaultdict(int)
    while end < len(order):
        seen[order[end]] += 1
        if len(seen) < need:
            end += 1
            continue
        front = max(range(begin, end + 1), key=lambda k: (order[k], -k))
        ahead = end + 1
        while ahead < len(order) and at[ahead] - at[front] <= 2 * size + SLACK:
            if order[ahead] > order[front] and at[ahead] - at[front] <= 2 * (order[ahead] - order[front]) + SLACK:
                for k in range(end + 1, ahead + 1):
                    seen[order[k]] += 1
                front = end = ahead
            ahead += 1
        end, place = max(end, front), order[front] + end - front
        while end + 1 < len(order) and at[end + 1] == at[end] + 1 and at[end] - at[front] == place - order[front] and place + 1 < len(template) and order[end + 1] == template[place + 1]:
            end, place = end + 1, place + 1
            seen[order[end]] += 1
        while seen[order[begin]] > 1 and at[begin] < at[front] - order[front]:
            seen[order[begin]] -= 1
            begin += 1
        yield begin, end, len(seen) / size
        seen.clear()
        begin = end = end + 1


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per match: doc_id, license, template, first_word, end_word (of the text's normalised words), containment."""
    schema = "doc_id long, license string, template string, first_word long, end_word long, containment double"
    templates = TEMPLATES + license_texts() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, bands, containment)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for part in tx.blocks(batch, "text", tx.BLOCK_BYTES // 3):
                rows = scanner.scan(*tx.buffers(part.column("text")))
                if rows:
                    d, t, a, b, share = zip(*rows, strict=True)
                    key = part.column("doc_id").take(pa.array(d, pa.int64()))
                    license_, template = (pa.array([scanner.templates[x][k] for x in t], pa.string()) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([key, license_, template, pa.array(a, pa.int64()), pa.array([x + SHINGLE - 1 for x in b], pa.int64()), pa.array(share, pa.float64())], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def brute_force(text: str | None, templates=None, containment: float = CONTAINMENT) -> list[tuple[str, str, int, int]]:
    """(license, template, first word, end word) of every occurrence, over the whole text and word by word; for tests."""
    grams = lambda x: [tuple(w[i : i + SHINGLE]) for w in [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))] for i in range(len(w) - SHINGLE + 1)]
    own, found = grams(text), []
    for license_, name, body in TEMPLATES if templates is None else templates:
        order = {g: i for i, g in reversed(list(enumerate(grams(body))))}
        at, i = [k for k, g in enumerate(own) if g in order], 0
        while i < len(at):
            j = next((j for j in range(i, len(at)) if len({own[k] for k in at[i : j + 1]}) >= containment * len(order) - 1e-9), None)
            if j is None:
                break
            places = lambda k: order[own[at[k]]]  # noqa: B023, E731
            front = min((k for k in range(i, j + 1)), key=lambda k: (-places(k), k))
            for k in range(j + 1, len(at)):
                if places(k) > places(front) and at[k] - at[front] <= min(2 * (places(k) - places(front)), 2 * len(order)) + SLACK:
                    front = j = k
            whole, p = grams(body), places(front) + j - front
            while j + 1 < len(at) and at[j + 1] == at[j] + 1 and at[j] - at[front] == p - places(front) and p + 1 < len(whole) and own[at[j + 1]] == whole[p + 1]:
                j, p = j + 1, p + 1
            while own[at[i]] in {own[k] for k in at[i + 1 : j + 1]} and at[i] < at[front] - places(front):
                i += 1
            found.append((license_, name, at[i], at[j] + SHINGLE))
            i = j + 1
    return sorted(found)
