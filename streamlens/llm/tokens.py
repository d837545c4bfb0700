"""Token ids of whole texts, computed piece by piece from a cache.

The tokenizers used here lower-case texts, drop white space and never join tokens across it, nor
between a letter and an ASCII character that is neither letter nor apostrophe. A text is
cut at those places, and the ids of its pieces, one after another, are its ids; a test
holds this against encoding whole texts. Pieces of ASCII are lower-cased beforehand, to share one cache entry; others
are encoded as they stand, because the tokenizer composes a letter with the marks behind it before it lower-cases.
Special tokens' strings are kept whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from streamlens.llm import text as tx

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces kept by one Python worker (about 30 bytes each) before its cache starts anew.
CACHE_PIECES = 2_000_000
#: Pieces encoded in one call, with a separator between them.
_JOINED = 64
_SEPARATOR = "|"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN &= ~_LETTER
_PLAIN[0x27] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, the pieces' starts, ends and hashes, and each text's first piece."""
    w = tx.words(column)
    data = w.data
    if not len(data):
        return b"", w.start, w.end, np.zeros(0, np.uint64), w.first
    letter = _LETTER[data]
    lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & (data[1:] >= 0x80) & (data[1:] < 0xC0)  # Latin letters of two bytes,
    lead &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # but the signs for times and divided by,
    lead &= ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))  # and capital I with dot: its lower case ends in a mark, which joins what follows
    letter[:-1] |= lead
    letter[1:] |= lead
    plain = _PLAIN[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & plain[1:]) | (plain[:-1] & letter[1:])
    low = _LOWER[data]
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # "<|"
    for k in np.unique(np.searchsorted(w.start, special, side="right") - 1).tolist():
        a, b = int(w.start[k]), int(w.end[k])
        cut[a:b], low[a:b] = False, data[a:b]
    cut[w.start] = False
    at = np.flatnonzero(cut)
    start, end = np.sort(np.concatenate([w.start, at])), np.sort(np.concatenate([w.end, at]))
    beyond = np.concatenate([[0], np.cumsum(data >= 0x80)])
    whole = np.flatnonzero(beyond[end] > beyond[start])  # pieces that are not ASCII keep their bytes
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[whole]] += 1
    inside[end[whole]] -= 1
    low = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, data, low)
    hashes = tx.substring_hash(tx.rolling(low.astype(np.uint16) + 1), start, end)
    return low.tobytes(), start, end, hashes, np.searchsorted(start, w.offsets)


class PieceTokenizer:
    """ids(column) gives the ids of every text of a column, flat, with one offset per text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(str(path))
        #: The narrowest little-endian type that holds every id.
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self._tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        alone = self._tokenizer.encode(f"a {_SEPARATOR} b", add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 and alone.count(mark[0]) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._begin = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int32)
        self._flat = np.zeros(0, np.uint32)

    def _encode(self, missing: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each piece."""
        call = lambda x: self._tokenizer.encode_batch_fast(x, add_special_tokens=False)
        joined = [i for i, x in enumerate(missing) if _SEPARATOR not in x] if self._mark is not None else []
        sizes = np.zeros(len(missing), np.int64)
        groups = [joined[i : i + _JOINED] for i in range(0, len(joined), _JOINED)]
        together = [e.ids for e in call([f" {_SEPARATOR} ".join(missing[i] for i in g) + f" {_SEPARATOR}" for g in groups])]
        lone = sorted(set(range(len(missing))) - set(joined))
        apart = [e.ids for e in call([missing[i] for i in lone])]
        a = np.array([i for x in together for i in x], np.uint32)
        ends = np.flatnonzero(a == self._mark) if self._mark is not None else np.zeros(0, np.int64)
        if len(ends) != len(joined):
            raise ValueError("a piece's ids hold the separator's id")
        sizes[joined] = np.diff(ends, prepend=-1) - 1
        sizes[lone] = [len(x) for x in apart]
        flat = np.zeros(int(sizes.sum()), np.uint32)
        of = np.repeat(np.arange(len(missing)), sizes)
        is_joined = np.zeros(len(missing), bool)
        is_joined[joined] = True
        flat[is_joined[of]] = a[a != self._mark] if self._mark is not None else a
        flat[~is_joined[of]] = np.array([i for x in apart for i in x], np.uint32)
        return flat, sizes

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, start, end, hashes, first = pieces(column)
        distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._keys) + len(distinct) > CACHE_PIECES:
            self._clear()
        place = np.searchsorted(self._keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self._keys)
        known[inside] = self._keys[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            at = one[new]
            flat, sizes = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            begin = len(self._flat) + np.cumsum(sizes) - sizes
            self._flat = np.concatenate([self._flat, flat])
            self._keys = np.insert(self._keys, place[new], distinct[new])
            self._begin = np.insert(self._begin, place[new], begin)
            self._size = np.insert(self._size, place[new], sizes)
            place = np.searchsorted(self._keys, distinct)
        sizes = self._size[place][inverse].astype(np.int64)
        begin = self._begin[place][inverse]
        to = np.cumsum(sizes)
        flat = self._flat[np.repeat(begin - (to - sizes), sizes) + np.arange(int(to[-1]) if len(to) else 0)]
        return flat, np.concatenate([[0], to])[first]


_LOADED: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer for this file, loaded once."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]
