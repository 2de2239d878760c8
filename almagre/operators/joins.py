"""Joins beyond plain equality, each with an equality key that keeps it distributed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagre.functions.similarity import haversine
from almagre.session import cut

KM_PER_DEGREE = 111.19


def close_pairs(df: DataFrame, key: list[str], order: str, value: str, most: float, condition: Column) -> DataFrame:
    """Pairs of rows with equal keys, ``order`` rising, whose values differ by ``most`` at most, as columns a_* and b_*.

    The value range is cut into bins of width ``most``; a row meets its own bin and the two beside it, so a key with many
    rows is split by value. Rows with a null key or value have no pair.
    """
    rows = df.where(" and ".join(f"{c} is not null" for c in [*key, value])).withColumn("bin", F.floor(F.col(value) / most).cast("bigint"))
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in df.columns], *key, "bin")
    right = rows.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in df.columns], *key, "bin")
    near = F.abs(F.col(f"a_{value}") - F.col(f"b_{value}")) <= most
    return left.join(right, [*key, "bin"]).where(near & (F.col(f"a_{order}") < F.col(f"b_{order}")) & condition).drop(*key, "bin")


def within_km(points: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """Points and centres ``(…, lat, lon)`` not further apart than ``km``, with the distance.

    Both are put in cells of ``km`` height; a point meets the centres of its cell and those around. The number of cells around the earth
    falls with the latitude of the band, and the last one borders on the first, so no pair is missed (up to 85 degrees).
    """
    step = km / KM_PER_DEGREE
    band = F.floor(F.col("lat") / step)
    # so many whole cells around the earth that each is at least km wide anywhere in the band
    widest = lambda b: F.cos(F.radians(F.least(F.lit(85.0), F.greatest(F.abs(b * step), F.abs((b + 1) * step)) + step)))
    around = lambda b: F.greatest(F.lit(1), F.floor(widest(b) * 360 / step))
    cell = lambda b: F.pmod(F.floor((F.col("lon") + 180) / 360 * around(b)), around(b))
    points = points.withColumn("band", band).withColumn("cell", cell(F.col("band")))
    near = (
        centres.withColumn("band", F.explode(F.array(*[band + i for i in (-1, 0, 1)])))
        .withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod(cell(F.col("band")) + i, around(F.col("band"))) for i in (-1, 0, 1)]))))
        .withColumnsRenamed({"lat": "lat_c", "lon": "lon_c"})
    )
    distance = haversine(F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c"))
    return points.join(near, ["band", "cell"]).withColumn("km", distance).where(F.col("km") <= km).drop("band", "cell")


#: Rules up to which they are broadcast (a term and a label each); letters of a term by which more are joined.
BROADCAST_RULES, TERM_LETTERS = 10_000, 3


def first_rule(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Each row with the label of the first rule ``(rank, term, label)`` whose term its text contains; null if none.

    Distinct texts are compared, not rows. A short list of rules is broadcast; with a long one each text meets only the rules
    whose first letters stand in it, and all rules of fewer letters.
    """
    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    contains = F.contains(F.col(text), F.col("term"))
    if rules.count() <= BROADCAST_RULES:
        pairs = texts.join(F.broadcast(rules), contains)
    else:
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - TERM_LETTERS + 1)), lambda i: F.substring(F.col(text), i, TERM_LETTERS)))
        keyed = texts.withColumn("piece_", F.explode(pieces)).join(rules.where(F.length("term") >= TERM_LETTERS).withColumn("piece_", F.substring("term", 1, TERM_LETTERS)), "piece_")
        # terms of fewer letters are all substrings of so many letters that a text has
        short = [texts.withColumn("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(F.col(text), i, n))))).where(F.length("term") == n).join(rules.where(F.length("term") == n), "term") for n in range(1, TERM_LETTERS)]  # noqa: B023
        empty = texts.join(F.broadcast(rules.where("term = ''").orderBy("rank").limit(1)))
        pairs = reduce(lambda x, y: x.unionByName(y), [keyed.where(contains).drop("piece_"), *[s.where(F.length(text) > 0) for s in short], empty])
    hit = pairs.groupBy(text).agg(F.min_by("label", "rank").alias("label"))
    return df.join(hit, text, "left")


def spine(df: DataFrame, date: str, first: Column, last: Column, spark=None) -> DataFrame:
    """All dates from first to last with the rows of each; a date without rows stands once with nulls."""
    days = (spark or df.sparkSession).range(1).select(F.explode(F.sequence(first, last)).alias(date))
    return days.join(df, date, "left")


def favourites(df: DataFrame, wanted: dict[str, list[str]], lists: list[str]) -> DataFrame:
    """Rows with the labels of the preferences they meet, as ``matched``; rows that meet none have an empty list.

    ``wanted`` has values by column; columns in ``lists`` hold arrays. Preferences are one user's short lists.
    """
    hits = []
    for col, values in wanted.items():
        for v in values:
            there = F.array_contains(col, v) if col in lists else F.col(col) == v
            hits.append(F.when(there, F.lit(f"{col}: {v}")))
    return df.withColumn("matched", F.array_compact(F.array(*hits)))


def moved_dates(df: DataFrame, key: list[str], date: str, order: str, most: int, condition: Column) -> DataFrame:
    """Earlier rows with the first later row of the key, at most so many days after, that meets the condition (a_*, b_*)."""
    days = df.withColumn("day_", F.datediff(F.col(date), F.lit("2000-01-01").cast("date")))
    pairs = close_pairs(days, key, "day_", "day_", most, condition)
    first = Window.partitionBy(f"a_{order}").orderBy(f"b_{order}")
    return pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "a_day_", "b_day_")


def in_parts(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """The rows with ``key_`` (their group) and ``part_``: ranges of group and order, so that a group of any size lies in many partitions, in order."""
    return cut(df.withColumn("key_", F.struct(*group)).repartitionByRange("key_", *order).withColumn("part_", F.spark_partition_id()))


def nearest_value(points: DataFrame, at: str, anchors: DataFrame, anchor: str, group: list[str]) -> DataFrame:
    """Each point with the nearest anchor of its group, the smaller of two as near; no pair is formed.

    Points and anchors are sorted together in ranges; the last anchor before and the first after are the only candidates, and where a
    range has none they come from the ranges beside it, of which one row each is looked at.
    """
    both = points.withColumn("x_", F.col(at).cast("double")).withColumn("a_", F.lit(None).cast("double")).unionByName(
        anchors.select(*group, F.col(anchor).cast("double").alias("x_"), F.col(anchor).cast("double").alias("a_")), allowMissingColumns=True
    )
    rows = in_parts(both, group, ["x_"])
    ends = rows.groupBy("key_", "part_").agg(F.max("a_").alias("top"), F.min("a_").alias("bottom"))
    around = Window.partitionBy("key_").orderBy("part_")
    before = F.max("top").over(around.rowsBetween(Window.unboundedPreceding, -1)).alias("before_")
    after = F.min("bottom").over(around.rowsBetween(1, Window.unboundedFollowing)).alias("after_")
    rows = rows.join(ends.select("key_", "part_", before, after), ["key_", "part_"])
    w = Window.partitionBy("key_", "part_").orderBy("x_", F.col("a_").asc_nulls_last())
    low = F.coalesce(F.last("a_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("before_"))
    high = F.coalesce(F.first("a_", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("after_"))
    near = F.when(low.isNull() | (high - F.col("x_") < F.col("x_") - low), high).otherwise(low)
    return rows.withColumn(anchor, near).where(F.col("a_").isNull()).drop("x_", "a_", "key_", "part_", "before_", "after_")
