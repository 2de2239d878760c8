"""Similarities, scores, hashes and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almagre.functions.text import clipped_slug, normalized

EARTH_KM = 6371.0


def words(col: Column) -> Column:
    """The distinct words of more than one character of a normalised text."""
    return F.array_distinct(F.filter(F.split(col, " "), lambda w: F.length(w) > 1))


def share_of_larger(a: Column, b: Column) -> Column:
    """Common elements over the larger set; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def share_of_smaller(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def fuzzy(a: Column, b: Column) -> Column:
    """Of two normalised texts: 1 if equal, 0 if one is empty, else the better of shared words and edit distance."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0)
        .otherwise(F.greatest(share_of_larger(words(a), words(b)), edit))
    )


def contained(a: Column, b: Column, value: float) -> Column:
    """Of two normalised texts: 1 if equal, ``value`` if one contains the other, else the share of common words."""
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), value).otherwise(share_of_larger(words(a), words(b)))
    )


def soft_share(a: Column, b: Column, least: float) -> Column:
    """Share of the shorter list's names that have a name at least so similar in the other; 0 if one is empty."""
    hit = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: fuzzy(normalized(x), normalized(y)) >= least)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.when(F.size(a) <= F.size(b), hit(a, b)).otherwise(hit(b, a)) / F.least(F.size(a), F.size(b))
    )


def filled_score(weights: dict[str, int], per_item: dict[str, tuple[int, int]]) -> Column:
    """Points for each filled field, and for each element of a list up to a most."""
    parts = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), w).otherwise(0) for c, w in weights.items()]
    parts += [F.least(F.lit(most), F.coalesce(F.size(c), F.lit(0)) * w) for c, (w, most) in per_item.items()]
    return sum(parts[1:], parts[0])


def confidence(sources: Column, known: dict[str, int], default: int, per_source: int, most: int) -> Column:
    """The best source's confidence, and some more for each further source, up to a most."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    best = F.array_max(F.transform(sources, lambda s: F.coalesce(F.try_element_at(table, s), F.lit(default))))
    return F.least(F.lit(most), best + per_source * (F.size(sources) - 1))


def rounded(col: Column, places: int) -> Column:
    """Rounded half up, towards plus infinity."""
    scale = 10**places
    return F.floor(col * scale + 0.5) / scale


def sha_id(prefix: str, *cols: Column, length: int = 14) -> Column:
    """A stable id: the first hexadecimal digits of a SHA-1 over the parts, nulls as empty."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(text), 1, length))


def slug_id(prefix: str, *cols: Column, most: int = 70) -> Column:
    """A readable id of the parts' words, of bounded length."""
    return clipped_slug(F.concat_ws("-", F.lit(prefix), *cols), most)


def rolling_hash(col: Column) -> Column:
    """The wrapping 31-multiplier hash of a text's code points, as an unsigned 32-bit number."""
    codes = F.transform(F.split(col, ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % (1 << 32))


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Kilometres along the earth's surface."""
    dlat, dlon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def upper_median(values: Column) -> Column:
    """The middle of a list, the upper one if it is even; null if it is empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def at_share(values: Column, share: float) -> Column:
    """The element of a sorted list at a share of its length."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * share).cast("int"))


def nearest(values: Column, to: Column) -> Column:
    """The index (from 0) of the value nearest to a number, the first of equals."""
    gaps = F.transform(values, lambda v: F.abs(v - to))
    return F.array_position(gaps, F.array_min(gaps)) - 1
