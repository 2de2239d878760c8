"""Records out of text: splitting, repeated matches, positional assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagre.functions.arrays import split_names
from almagre.functions.text import first_filled, squeezed
from almagre.operators.joins import in_parts


def blocks(col: Column, before: str, containing: str) -> Column:
    """The pieces of a text that begin where ``before`` matches and contain a pattern."""
    return F.filter(F.split(col, f"(?={before})"), lambda b: b.rlike(containing))


def repeated(col: Column, pattern: str, fields: dict[str, int]) -> Column:
    """Each match of a pattern as a struct of its groups, in order."""
    groups = [F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(i)), squeezed).alias(name) for name, i in fields.items()]
    return F.arrays_zip(*groups)


def between(col: Column, opening: str, closing: str) -> Column:
    """What stands between two markers (patterns), or null."""
    return F.nullif(squeezed(F.regexp_extract(col, rf"(?s){opening}(.*?)(?:{closing}|$)", 1)), F.lit(""))


def lineup(col: Column, herd: list[str], people: list[str]) -> Column:
    """A struct of herd and people: the first of each list of patterns that matches gives its group 1."""
    own = first_filled(*[squeezed(F.regexp_extract(col, p, 1)) for p in herd])
    names = first_filled(*[squeezed(F.regexp_extract(col, p, 1)) for p in people])
    return F.struct(own.alias("breeding"), F.when(names.isNotNull(), split_names(names)).alias("participants"))


def fragments(df: DataFrame, text: str, marker: str) -> DataFrame:
    """A row per piece of a text, each beginning at a marker, with its position."""
    return df.select("*", F.posexplode(F.filter(F.split(text, f"(?={marker})"), lambda x: F.trim(x) != "")).alias("pos", "fragment"))


def rolled_days(df: DataFrame, group: list[str], position: str, minutes: str, morning: int, most: Column | None = None) -> DataFrame:
    """The day index of items in order: it rises where times fall from before ``morning`` to after it again.

    A listing runs past midnight; the next day begins when the previous item is before the morning and this one isn't.
    """
    rows = in_parts(df, group, [position])
    # what a range needs of those before it: their last time, and how often the day turned in them
    around, w = Window.partitionBy("key_").orderBy("part_"), Window.partitionBy("key_", "part_").orderBy(position)
    last = rows.groupBy("key_", "part_").agg(F.max_by(minutes, position).alias("m_")).select("key_", "part_", F.lag("m_").over(around).alias("last_"))
    first = F.row_number().over(w) == 1
    rows = rows.join(last, ["key_", "part_"]).withColumn("lag_", F.when(first, F.col("last_")).otherwise(F.lag(minutes).over(w)))
    rows = rows.withColumn("turned_", F.when((F.col("lag_") < morning) & (F.col(minutes) >= morning), 1).otherwise(0))
    turns = rows.groupBy("key_", "part_").agg(F.sum("turned_").alias("t_"))
    turns = turns.select("key_", "part_", F.coalesce(F.sum("t_").over(around.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inner = F.sum("turned_").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(turns, ["key_", "part_"]).withColumn("day_index", inner + F.col("before_")).drop("turned_", "lag_", "last_", "before_", "key_", "part_")
    return out if most is None else out.withColumn("day_index", F.least(F.col("day_index"), most))


def best_dated(df: DataFrame, text: str, key: str, words: list[tuple[str, int]], around: int) -> DataFrame:
    """The best dated candidate of each text: dates scored by the words near them, the first of equals.

    ``(key, candidate, score, position)``; offsets come from splitting at the same pattern.
    """
    date = r"\d{1,2}/\d{1,2}/\d{4}"
    found = F.regexp_extract_all(text, F.lit(f"({date})"), F.lit(1))
    gaps = F.transform(F.split(text, date), F.length)
    offset = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + g) + F.aggregate(
        F.slice(found, 1, i), F.lit(0), lambda a, d: a + F.length(d)
    )
    rows = df.select(key, text, F.posexplode(found).alias("i", "candidate")).withColumn("position", offset(F.col("i")))
    start = F.greatest(F.lit(1), F.col("position") + 1 - around)
    near = F.substring(F.col(text), start, F.col("position") + 1 - start + F.length("candidate") + around)
    score = sum((F.when(F.contains(F.lower(near), F.lit(w)), n).otherwise(0) for w, n in words[1:]), F.when(F.contains(F.lower(near), F.lit(words[0][0])), words[0][1]).otherwise(0))
    scored = rows.withColumn("score", score)
    best = F.max_by(F.struct("candidate", "score", "position"), F.struct("score", -F.col("position"))).alias("r")
    return scored.groupBy(key).agg(best).select(key, "r.*")


def by_hours(df: DataFrame, text: str) -> DataFrame:
    """A row per entry of a schedule: the time each piece of the text begins with, what follows it, and its position. What stands before the first time is no entry."""
    at = r"(?<![\d:])(?:[01]?\d|2[0-3]):[0-5]\d(?!\d)"
    pieces = df.select("*", F.posexplode(F.split(text, f"(?={at})")).alias("pos", "piece_"))
    time = F.regexp_extract("piece_", f"^({at})", 1)
    rest = squeezed(F.regexp_replace("piece_", f"^{at}", ""))
    return pieces.where(time != "").select(*df.columns, "pos", F.lpad(time, 5, "0").alias("time"), rest.alias("entry")).where("entry <> ''")
