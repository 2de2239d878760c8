"""Lists and structs: cleaning, splitting, ordered merging, choosing between two values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagre.functions.text import squeezed


def cleaned(names: Column, most: int, unwanted: str) -> Column:
    """Distinct trimmed names in order, without empty, overlong and unwanted ones; null lists are empty."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    names = F.transform(F.array_compact(names), squeezed)
    return F.array_distinct(F.filter(names, lambda n: (n != "") & (F.length(n) <= most) & ~n.rlike(unwanted)))


def split_names(col: Column, most: int | None = None) -> Column:
    """Names separated by commas, semicolons, dots in the middle, "y" or "e"."""
    parts = F.array_distinct(F.filter(F.transform(F.split(col, r"\s*[,;·]\s*|\s+[ye]\s+"), squeezed), lambda n: n != ""))
    return parts if most is None else F.slice(parts, 1, most)


def merged(first: Column, second: Column, similar: Callable[[Column, Column], Column]) -> Column:
    """The first list and, in order, the elements of the second that aren't similar to one kept."""
    return F.aggregate(second, first, lambda kept, x: F.when(F.exists(kept, lambda k: similar(k, x)), kept).otherwise(F.array_append(kept, x)))


def best_per_name(details: Column) -> Column:
    """Of structs with name and confidence, the first most confident of each name, in order of first appearance."""
    names = F.array_distinct(F.transform(details, lambda d: d["name"]))

    def best(name: Column) -> Column:
        own = F.filter(details, lambda d: d["name"] == name)
        top = F.array_max(F.transform(own, lambda d: d["confidence"]))
        return F.get(F.filter(own, lambda d: d["confidence"] == top), 0)

    return F.transform(names, best)


def chosen(first: Column, second: Column, prefer_second: Column) -> Column:
    """The preferred one of two values, the other if it is null or empty."""
    a, b = F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))
    return F.when(prefer_second, F.coalesce(b, a)).otherwise(F.coalesce(a, b))


def toggled(values: Column, value: Column) -> Column:
    """A set without the value if it holds it, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def plain_names(names: Column, roles: str, unwanted: str) -> Column:
    """Names without roles before them, what stands in brackets and full stops behind; without those that match ``unwanted`` or hold no letter."""
    bare = F.transform(F.array_compact(F.coalesce(names, F.array().cast("array<string>"))), lambda n: F.regexp_replace(F.regexp_replace(n, r"\([^)]*\)", " "), rf"(?iu)^\s*(?:{roles})\s*:?\s+", ""))
    bare = F.transform(bare, lambda n: squeezed(F.regexp_replace(n, r"[\s.,;]+$", "")))
    return F.array_distinct(F.filter(bare, lambda n: n.rlike(r"\p{L}") & ~n.rlike(unwanted)))
