"""JSON, arrays, maps and structs: lenient parsing, label arrays, context keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(text: Column, schema: str, fallback: Column | None = None) -> Column:
    """Parsed JSON, or the fallback when it is missing or malformed."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, fallback) if fallback is not None else parsed


def labels(*rules: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first name whose condition holds, else null."""
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules])


def context_keys(**fields: Column) -> Column:
    """field:value for every field that is present and not empty, sorted by field."""
    parts = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}:"), F.lower(c.cast("string")))) for n, c in sorted(fields.items())]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def named_first(m: Column, key: str, otherwise: Column) -> Column:
    """The map's value when the key is present, even if empty, else another column."""
    return F.when(F.coalesce(F.map_contains_key(m, key), F.lit(False)), m[key]).otherwise(otherwise)


def nearest_rank(values: Column, share: float) -> Column:
    """The ceil(share * n)-th smallest value of an array (from 1)."""
    v = F.array_sort(values)
    return F.try_element_at(v, F.greatest(F.lit(1), F.ceil(F.size(v) * F.lit(share))).cast("int"))


def index_quantile(values: Column, share: float) -> Column:
    """The value at position int(share * (n - 1)) (from 0) of the sorted array."""
    v = F.array_sort(values)
    return F.try_element_at(v, (F.floor((F.size(v) - 1) * F.lit(share)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    v = F.array_sort(values)
    return F.try_element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int"))


def without(columns: Iterable[str], drop: Iterable[str]) -> list[str]:
    gone = set(drop)
    return [c for c in columns if c not in gone]


def keep_only(reasons: Column, allowed: list[str]) -> Column:
    return F.array_intersect(reasons, F.array(*map(F.lit, allowed)))
