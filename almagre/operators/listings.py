"""Programme grids: day headers, their calendar, positioned tokens; each group of rows is one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagre.functions.dates import hhmm
from almagre.functions.text import normalized, once

# The days of the week from Sunday, normalised.
WEEKDAYS = ("domingo", "lunes", "martes", "miercoles", "jueves", "viernes", "sabado")


def day_headers(text: Column, most: int = 15, enough: int = 7) -> Column:
    """The first run of different "weekday day" headers of a text, as structs (weekday from 0 = Sunday, day).

    A header that stood before is skipped until ``enough`` are found and ends the run after; at most ``most`` are taken.
    """
    pattern = rf"\b({'|'.join(WEEKDAYS)})\s+(\d{{1,2}})\b"
    plain = normalized(text)
    found = F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)).alias("w"), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)).alias("d"))
    number = F.create_map(*[F.lit(x) for i, w in enumerate(WEEKDAYS) for x in (w, i)])
    heads = F.transform(found, lambda h: F.struct(number[h["w"]].alias("weekday"), h["d"].cast("int").alias("day")))
    empty = F.array().cast("array<struct<weekday: int, day: int>>")

    def step(state: Column, h: Column) -> Column:
        kept, done = state["kept"], state["done"]
        seen = F.array_contains(kept, h)
        full = F.size(kept) >= most
        ends = done | full | (seen & (F.size(kept) >= enough))
        return F.struct(F.when(ends | seen, kept).otherwise(F.array_append(kept, h)).alias("kept"), ends.alias("done"))

    return F.aggregate(heads, F.struct(empty.alias("kept"), F.lit(False).alias("done")), step, lambda s: s["kept"])


def header_dates(headers: Column, as_of: Column, reach: int = 30) -> Column:
    """The dates of consecutive headers: the first start within ``reach`` days of ``as_of`` for which all weekdays and days fit; empty if none does."""

    def found(s: Column) -> Column:
        heads, day = s["heads"], s["day"]
        starts = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: F.date_add(day, i))
        at = lambda start, i: F.date_add(start, i)
        fits = lambda start: F.forall(s["places"], lambda i: (F.dayofmonth(at(start, i)) == F.get(heads, i)["day"]) & (F.dayofweek(at(start, i)) - 1 == F.get(heads, i)["weekday"]))
        dates = lambda first: F.when((F.size(heads) > 0) & first.isNotNull(), F.transform(s["places"], lambda i: F.date_add(first, i))).otherwise(F.array().cast("array<date>"))
        return once(F.get(F.filter(starts, fits), F.lit(0)), dates)

    # the headers are read once, not for every start and place
    places = lambda h: F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    return once(headers, lambda h: once(F.struct(h.alias("heads"), as_of.alias("day"), places(h).alias("places")), found))


def column_centres(tokens: DataFrame, page: list[str], columns: int = 7) -> DataFrame:
    """``(page…, centres)``: the middles of the first day headers from the left, or an even division between the 8th and 92nd percentile of all positions."""
    head = F.exists(F.array(*map(F.lit, WEEKDAYS)), lambda w: F.startswith(normalized(F.col("text")), w))
    # one number per header and page is kept; ranks come from counted positions, so no page is gathered
    heads = tokens.where(head).groupBy(*page).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("x", "width"))), lambda t: t["x"] + t["width"] / 2), 1, columns).alias("heads"), F.count("*").alias("n_heads"))
    xs = tokens.groupBy(*page, "x").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*page).orderBy("x")
    ranked = xs.withColumn("until", F.sum("n").over(before)).join(tokens.groupBy(*page).agg(F.count("*").alias("all")), page)
    at = lambda share: F.min(F.when(F.col("until") > F.floor(F.col("all") * share), F.col("x")))
    ends = ranked.groupBy(*page).agg(at(0.08).alias("low"), at(0.92).alias("high"))
    step = (F.col("high") - F.col("low")) / columns
    even = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.col("low") + step * (i + 0.5))
    return ends.join(heads, page, "left").select(*page, F.when(F.col("n_heads") >= columns, F.col("heads")).otherwise(even).alias("centres"))


def _nearest(centres: Column, x: Column) -> Column:
    gaps = F.transform(centres, lambda c: F.abs(c - x))
    return F.array_position(gaps, F.array_min(gaps)) - 1


def time_rows(tokens: DataFrame, centres: DataFrame, page: list[str], margin: float = 15) -> DataFrame:
    """``(page…, y, time)``: the rows of a grid by the times beside its columns, one per rounded height, at the upper median of its tokens."""
    beside = tokens.join(centres, page).withColumn("time", hhmm(F.col("text"))).where("time is not null")
    beside = beside.where((F.col("x") < F.array_min("centres") - margin) | (F.col("x") > F.array_max("centres") + margin))
    own = beside.groupBy(*page, F.floor(F.col("y") + 0.5).alias("line")).agg(F.array_sort(F.collect_list("y")).alias("ys"), F.min_by("time", F.struct("pos")).alias("time"))
    return own.select(*page, F.get("ys", F.floor(F.size("ys") / 2).cast("int")).alias("y"), "time")


def grid_events(tokens: DataFrame, page: list[str], keyword: str, columns: int = 7, reach: float = 45, line: float = 2) -> DataFrame:
    """``(page…, pos, column_no, time, text)`` of each token with the keyword: its column, the nearest row's time, and what stands around it in the column.

    Tokens are ``(page…, pos, x, y, width, text)``; heights grow upwards. Around it are the tokens of its column at most ``reach`` away, without
    times, by lines of height ``line`` from above, then from the left. A page without rows gives no times.
    """
    centres = column_centres(tokens, page, columns)
    placed = tokens.join(centres, page).withColumn("column_no", _nearest(F.col("centres"), F.col("x") + F.col("width") / 2))
    keys = placed.where(F.col("text").rlike(keyword)).select(*page, "column_no", F.col("pos").alias("key_pos"), F.col("y").alias("key_y"))
    band = lambda c: F.floor(c / reach).cast("bigint")
    near = placed.where(hhmm(F.col("text")).isNull()).select(*page, "column_no", "x", "y", "pos", "text", F.explode(F.array(*[band(F.col("y")) + i for i in (-1, 0, 1)])).alias("band"))
    around = keys.withColumn("band", band(F.col("key_y"))).join(near, [*page, "column_no", "band"]).where(F.abs(F.col("y") - F.col("key_y")) <= reach)
    order = F.struct((-F.floor(F.col("y") / line)).alias("l"), F.col("x").alias("x"), F.col("pos").alias("p"), F.col("text").alias("text"))
    cells = around.groupBy(*page, "key_pos", "key_y", "column_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda t: t["text"]), " ").alias("text"))
    rows = time_rows(tokens, centres, page).groupBy(*page).agg(F.collect_list(F.struct((-F.col("y")).alias("o"), "y", "time")).alias("rows"))
    row = F.get(F.array_sort(F.transform("rows", lambda r: F.struct(F.abs(r["y"] - F.col("key_y")).alias("gap"), r["o"].alias("o"), r["time"].alias("time")))), F.lit(0))
    return cells.join(rows, page, "left").select(*page, F.col("key_pos").alias("pos"), "column_no", F.coalesce(row["time"], F.lit("")).alias("time"), "text")
