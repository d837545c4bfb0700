import functools
import re
import string

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from streamlens.llm import text as tx
from streamlens.llm import tokens

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("abzAZ'sdtréÉÀ×÷ß̸́=.,-<|>5 \t\n\x0b\x0c\x1f  σΣİſ|_"), st.characters(codec="utf-8")), max_size=14)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_are_runs_of_other_bytes(texts):
    w = tx.words(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    got = [[raw[a:b] for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]


@functools.cache
def _whole(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_equal_whole_text_encoding(texts):
    path = tokens.vocabulary_path()
    whole = _whole(path)
    flat, offset = tokens.tokenizer(path).ids(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert flat[offset[i] : offset[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_special_tokens_and_separators_stay_whole():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a<|endoftext|>B", "<|ENDOFTEXT|>", "don't DON'T I'LL x'S", "a|b || |", ""]
    flat, offset = tokens.tokenizer(path).ids(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(offset[:-1], offset[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_dotted_capital_i_before_punctuation():
    path = tokens.vocabulary_path()
    texts = [t for p in string.punctuation for t in (f"\u0130{p}", f"KED\u0130{p}", f"{p}\u0130", f"\u0130{p}b\u0130{p}{p}")]
    flat, offset = tokens.tokenizer(path).ids(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(offset[:-1], offset[1:], strict=True)] == [_whole(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_substring_hash_depends_on_content_only():
    x = np.frombuffer(b"abcabcab", np.uint8).astype(np.uint16) + 1
    p = tx.rolling(x)
    h = tx.substring_hash(p, np.array([0, 3, 1, 0]), np.array([3, 6, 4, 4]))
    assert h[0] == h[1] and len({int(v) for v in h}) == 3


def test_blocks_cover_all_rows_and_sliced_arrays():
    b = pa.record_batch({"t": pa.array(["aa", None, "b" * 50, "", "c"])}).slice(1)
    parts = list(tx.blocks(b, "t", 10))
    assert sum(p.num_rows for p in parts) == 4
    w = [tx.words(p.column("t")).counts.tolist() for p in parts]
    assert sum(map(sum, w)) == 2


def test_letters_with_every_combining_mark():
    """Marks compose with a letter before it is lower-cased; a few capitals have no composed form where the small letter has one."""
    encode, whole = tokens.tokenizer(tokens.vocabulary_path()), _whole(tokens.vocabulary_path())
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250))]
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [a + m for a in letters for m in marks] + [f".{a}{m}{n} ok" for a in letters[:52] for m in marks[:16] for n in marks[:16:3]] + ["T\u0308 W\u030a ok"]
    for k in range(0, len(texts), 10_000):
        flat, offset = encode.ids(pa.array(texts[k : k + 10_000]))
        want = whole.encode_batch(texts[k : k + 10_000], add_special_tokens=False)
        assert [flat[offset[i] : offset[i + 1]].tolist() for i in range(len(want))] == [e.ids for e in want]
