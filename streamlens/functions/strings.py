"""Text normalisers, patterns, keys and phrase predicates as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)[\w']+"
CLIP_INTENT = r"(?i)(^|\s)(!clip\b|clip\s+(it|that|this)\b|mods?\s+clip\b|clip\s+(pls|please)\b)"
URL, MENTION, EMAIL, PHONE = r"https?://\S+", r"(?<!\w)@\w+", r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\+?\d[\d\s().-]{7,}\d"
#: Words for counts of a multiple, a fixed table.
MULTIPLES = {"double": 2, "triple": 3, "quad": 4, "quadra": 4, "penta": 5}


def clean(x: Column) -> Column:
    """NUL to space, white space collapsed, ends trimmed; null gives an empty text."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "\0", " "), r"\s+", " "))


def tokens(x: Column, begins: list[str] | None = None) -> Column:
    """Lower-cased words with apostrophes, accents kept; only those that begin with one of begins, when given."""
    word = WORD if begins is None else rf"(?U)(?<![\w'])(?:{'|'.join(map(re.escape, begins))})[\w']*"
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(word), F.lit(0))


def phrase_text(x: Column, limit: int | None = 240) -> Column:
    """Words joined by one space; search queries are cut at a limit, documents (limit None) are not."""
    text = F.array_join(tokens(x), " ")
    return text if limit is None else F.left(text, F.lit(limit))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts, one per line; nulls are empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def milliseconds(x: Column) -> Column:
    return F.bround(x * 1000).cast("long")


def contains_phrase(x: Column, phrase: str) -> Column:
    """Whole-phrase match, flexible in white space and case."""
    return F.coalesce(x, F.lit("")).rlike(r"(?i)\b" + r"\s+".join(map(re.escape, phrase.split())) + r"\b")


def starts_any(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(prefix)))


def is_clip_intent(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(CLIP_INTENT)


def twitch_key(url: Column) -> Column:
    """twitch:<id> for a video address, otherwise host and path in lower case without a closing slash."""
    video = F.regexp_extract(url, r"(?i)twitch\.tv/(?:videos|[^/]+/v(?:ideo)?)/(\d+)", 1)
    plain = F.regexp_replace(F.lower(F.regexp_replace(url, r"^[a-zA-Z]+://(www\.)?|[?#].*$", "")), "/+$", "")
    return F.when(video != "", F.concat(F.lit("twitch:"), video)).otherwise(plain)


def message_weight(text: Column, emotes: Column, hype: Column) -> Column:
    """1 + .6 per emote + .8 for hype words + .5 for a character four times in a row."""
    return 1 + 0.6 * emotes + 0.8 * hype.cast("int") + 0.5 * F.coalesce(text, F.lit("")).rlike(r"(.)\1{3,}").cast("int")


def shareable_phrase(x: Column, limit: int = 64) -> Column:
    """A message without addresses, mentions and numbers to call, for counting repeats; intents collapse to one constant; null when nothing short is left."""
    text = F.lower(clean(x))
    for pattern in (URL, EMAIL, MENTION, PHONE):
        text = F.regexp_replace(text, pattern, " ")
    text = F.when(is_clip_intent(x), F.lit("clip that")).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when((text != "") & (F.length(text) <= limit), text)


def screen_text(x: Column) -> Column:
    """Text read from a screen: upper case, bars and exclamation marks as I, only A-Z, 0-9, # and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.upper(F.coalesce(x, F.lit(""))), "|!", "II"), "[^A-Z0-9# ]+", " "), " +", " "))


def whole_words(x: Column, limit: int) -> Column:
    """At most limit characters, cut at a word's end."""
    text = clean(x)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_extract(text, rf"^(.{{0,{limit}}})(?=\s|$)", 1))


def label_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[_-]+", " "))


def terms(x: Column, stop: list[str]) -> Column:
    """Words without stop words, and their neighbours as a::b."""
    words = F.filter(tokens(x), lambda w: ~w.isin(stop) & (F.length(w) > 1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("::"), b))
    return F.concat(words, pairs)


def largest_number(x: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\d{1,9}"), F.lit(0)), lambda d: d.cast("int")))


def multiple_count(x: Column) -> Column:
    """The largest multiple that is named by a word, or by a digit from 2 to 5 before 'kills'; 0 if none."""
    text = F.lower(F.coalesce(x, F.lit("")))
    named = [F.when(text.rlike(rf"\b{w}\b"), F.lit(n)).otherwise(F.lit(0)) for w, n in MULTIPLES.items()]
    digit = F.coalesce(F.regexp_extract(text, r"\b([2-5])\s*kills?\b", 1).try_cast("int"), F.lit(0))
    return F.greatest(digit, *named)


def latin_only(x: Column) -> Column:
    """Words without a letter outside the Latin script."""
    return F.array_join(F.filter(F.split(clean(x), " "), lambda w: ~w.rlike(r"[\p{L}&&[^\p{IsLatin}]]")), " ")


def bare_word(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def token_sketch(x: Column, stop: list[str], size: int = 24) -> Column:
    """Sorted hashes (8 hex digits of sha256) of the distinct words that are not stop words; at most size."""
    words = F.array_distinct(F.filter(tokens(x), lambda w: ~w.isin(stop)))
    return F.slice(F.array_sort(F.transform(words, lambda w: F.left(F.sha2(w, 256), F.lit(8)))), 1, size)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def append_distinct(a: Column, b: Column) -> Column:
    """Words of a then b, each once regardless of case, in their first spelling."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.filter(both, lambda w, i: F.array_position(F.transform(both, F.lower), F.lower(w)) == i + 1)


def fill_template(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def window_id(*parts: Column) -> Column:
    """A deterministic identifier in the form of a uuid, from a digest of the parts."""
    h = F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])
