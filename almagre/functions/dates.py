"""Dates, times and instants typed in texts. ``as_of`` is always a parameter; ANSI-safe throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Spanish months, without accents.
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
ZONE = "Europe/Madrid"


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date of texts for its parts; null if there is none or it isn't in the calendar."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (month != "") & (day != ""), F.try_to_date(text, "yyyy-MM-dd"))


def month_number(name: Column) -> Column:
    """The number of a Spanish month, as text; empty if it is none."""
    out = F.when(name == "setiembre", "9")
    for i, m in enumerate(MONTHS, 1):
        out = out.when(name == m, str(i))
    return out.otherwise("")


def spanish_date(col: Column) -> Column:
    """The first "d de month de yyyy" of a text (lower case, without accents)."""
    at = r"(\d{1,2})\s+de\s+([a-z]+)\s+(?:de|del)\s+(\d{4})"
    part = lambda i: F.regexp_extract(col, at, i)
    return _made(part(3), month_number(part(2)), part(1))


def numeric_date(col: Column) -> Column:
    """The first d/m/yyyy of a text, with slashes, points or hyphens; years of two figures are of this century."""
    at = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?!\d)"
    part = lambda i: F.regexp_extract(col, at, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return _made(year, part(2), part(1))


def all_numeric_dates(col: Column) -> Column:
    """All d/m/yyyy of a text that are in the calendar, in order."""
    found = F.regexp_extract_all(col, F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), F.lit(1))
    return F.array_compact(F.transform(found, numeric_date))


def in_year(day_month: Column, as_of: Column, back_months: int = 6) -> Column:
    """A "d/m" in the year of ``as_of``, or the next one if it lies more than so many months before."""
    part = lambda i: F.regexp_extract(day_month, r"^(\d{1,2})/(\d{1,2})$", i)
    late = F.coalesce(part(2).try_cast("int"), F.lit(0)) < F.month(as_of) - back_months
    return _made((F.year(as_of) + late.cast("int")).cast("string"), part(2), part(1))


def hhmm(col: Column) -> Column:
    """The first time of a text as HH:MM, whatever its separator; null if there is none or it isn't on the clock."""
    at = r"(?i)(?:^|[^\d:.])([01]?\d|2[0-3])[:.h]([0-5]\d)(?!\d)"
    hour, minute = F.regexp_extract(col, at, 1), F.regexp_extract(col, at, 2)
    return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def minutes(col: Column) -> Column:
    """Minutes since midnight of a strict H:MM; null for anything else."""
    ok = col.rlike(r"^\d{1,2}:\d{2}$")
    return F.when(ok, F.split_part(col, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(col, F.lit(":"), F.lit(2)).try_cast("int"))


def closeness(a: Column, b: Column, steps: list[tuple[int, float]]) -> Column:
    """A step function of the distance of two numbers: the value of the first step not exceeded, 0 beyond or for nulls."""
    out = F.when(a.isNull() | b.isNull(), 0.0)
    for most, value in steps:
        out = out.when(F.abs(a - b) <= most, value)
    return out.otherwise(0.0)


def day_distance(a: Column, b: Column) -> Column:
    """Days between two dates, whichever is first; null if one isn't known."""
    return F.abs(F.datediff(a, b))


def within(day: Column, as_of: Column, before: int, after: int) -> Column:
    """Whether a date lies in the window around ``as_of``, both ends included."""
    return day.between(F.date_sub(as_of, before), F.date_add(as_of, after))


def to_utc(date: Column, time: Column, zone: str = ZONE) -> Column:
    """The instant (zone-less, UTC) of a local date and HH:MM; null unless both are well formed.

    At the changes of the clock Spark's rule holds: a time that doesn't exist moves on, one that exists twice is the first.
    """
    ok = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & time.rlike(r"^\d{1,2}:\d{2}$")
    wall = F.try_to_timestamp(F.concat(date, F.lit(" "), F.lpad(time, 5, "0")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    return F.when(ok, F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))


def in_zone(utc: Column, zone: str) -> Column:
    """A UTC instant as wall time of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def shifted_time(utc: Column, home: str, zone: str) -> Column:
    """HH:MM in a zone, with "+n" or "-n" where the day is another than at home."""
    there = in_zone(utc, zone)
    shift = F.datediff(there, in_zone(utc, home))
    mark = F.when(shift > 0, F.concat(F.lit(" +"), shift)).when(shift < 0, F.concat(F.lit(" "), shift)).otherwise("")
    return F.concat(F.date_format(there, "HH:mm"), mark)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from one instant to another, rounded up."""
    return F.ceil((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000)


def span_status(start: Column, length: Column, now: Column, soon: int = 15) -> Column:
    """live, finished, soon, today, tomorrow, future or unknown; the end is exclusive."""
    end = start + F.make_dt_interval(mins=length)
    days = F.datediff(start, now)
    return (
        F.when(start.isNull(), "unknown").when((now >= start) & (now < end), "live").when(now >= end, "finished")
        .when(minutes_between(now, start) <= soon, "soon").when(days == 0, "today").when(days == 1, "tomorrow").otherwise("future")
    )


def remaining(total: Column) -> Column:
    """Minutes as "1 d 2 h 3 min", without parts that are 0."""
    days, hours, mins = F.floor(total / 1440), F.floor(total % 1440 / 60), total % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("bigint").cast("string"), F.lit(f" {unit}")))
    return F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(mins, "min"))


def relative_day(day: Column, as_of: Column) -> Column:
    """ayer, hoy, mañana or null."""
    d = F.datediff(day, as_of)
    return F.when(d == -1, "ayer").when(d == 0, "hoy").when(d == 1, "mañana")


def eve_at(day: Column, hour: int) -> Column:
    """The evening before a day, at an hour."""
    return F.date_sub(day, 1).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))


def before(start: Column, mins: Column, least: int = 5, most: int = 1440, otherwise: int = 30) -> Column:
    """The instant so many minutes before a start; a lead time out of bounds counts as the default."""
    return start - F.make_dt_interval(mins=F.when(mins.between(least, most), mins).otherwise(otherwise))


def week_dates(col: Column) -> Column:
    """The seven dates of "del d [de month] al d de month de yyyy"; null if they aren't seven."""
    at = r"(?i)del\s+(\d{1,2})(?:\s+de\s+([a-z]+))?\s+al\s+(\d{1,2})\s+de\s+([a-z]+)\s+de\s+(\d{4})"
    part = lambda i: F.regexp_extract(col, at, i)
    last_month = month_number(F.lower(part(4)))
    first_month = F.when(part(2) == "", last_month).otherwise(month_number(F.lower(part(2))))
    last = _made(part(5), last_month, part(3))
    same = _made(part(5), first_month, part(1))
    first = F.when(same > last, F.add_months(same, -12)).otherwise(same)
    dates = F.sequence(first, last)
    return F.when((F.datediff(last, first) == 6), dates)


def sundays(as_of: Column, n: int) -> Column:
    """The next Sundays; a Sunday itself counts."""
    first = F.next_day(F.date_sub(as_of, 1), "SUN")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(first, i * 7))


def published_year(day_month: Column, published: Column, late_days: int = 45) -> Column:
    """A "d/m" in the year it was published, or the next one if that lies more than so many days before the publication."""
    part = lambda i: F.regexp_extract(day_month, r"^(\d{1,2})/(\d{1,2})$", i)
    same = _made(F.year(published).cast("string"), part(2), part(1))
    later = _made((F.year(published) + 1).cast("string"), part(2), part(1))
    return F.when(same < F.date_sub(published, late_days), later).otherwise(same)


def year_of(col: Column, as_of: Column) -> Column:
    """The first year of four figures in a text that isn't over; else that of ``as_of``."""
    years = F.transform(F.regexp_extract_all(col, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)), lambda y: y.try_cast("int"))
    return F.coalesce(F.get(F.filter(years, lambda y: y >= F.year(as_of)), F.lit(0)), F.year(as_of))


def dates_with_places(col: Column) -> Column:
    """All d/m/yyyy of a text as structs (date, text, start), in order; ``start`` counts characters from 0, ``date`` is null off the calendar."""
    at = r"\d{1,2}/\d{1,2}/\d{4}"
    found, gaps = F.regexp_extract_all(col, F.lit(f"({at})"), F.lit(1)), F.transform(F.split(col, at), F.length)
    total = lambda xs, n, size: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + size(x))
    return F.transform(found, lambda d, i: F.struct(numeric_date(d).alias("date"), d.alias("text"), (total(gaps, i + 1, lambda x: x) + total(found, i, F.length)).alias("start")))


def spoken_time(col: Column) -> Column:
    """A time said as "comienza a las 7", "desde las 18.30" or "17h", as HH:MM; null if there is none on the clock."""
    text = F.lower(col)
    begins = r"(?:comienza|comenzamos|empieza|inicio|arranca|en directo|conexi[oó]n|a partir de|desde|hoy|esta tarde|esta noche|a)\s+(?:a\s+)?las?\s+([01]?\d|2[0-3])(?:[:h.]([0-5]\d))?(?!\d)"
    short = r"(?<![\d:.])([01]?\d|2[0-3])\s?h(?:oras?)?(?![\p{L}\d])"
    hour = F.coalesce(F.nullif(F.regexp_extract(text, begins, 1), F.lit("")), F.nullif(F.regexp_extract(text, short, 1), F.lit("")))
    minute = F.coalesce(F.nullif(F.regexp_extract(text, begins, 2), F.lit("")), F.lit("00"))
    return F.when(hour.isNotNull(), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates as a double; infinite if one isn't known, so that no limit is met."""
    return F.coalesce(day_distance(a, b).cast("double"), F.lit(float("inf")))


def weekday_number(day: Column) -> Column:
    """The day of the week, 0 for Sunday."""
    return F.dayofweek(day) - 1


def iso_day(day: Column) -> Column:
    """A date as yyyy-MM-dd."""
    return F.date_format(day, "yyyy-MM-dd")


def duration(explicit: Column, content: Column, kind: Column) -> Column:
    """Minutes an event lasts: as said, if that is more than 0; else by what it is. Fixed values."""
    usual = F.when(content == "programa", 60).when(kind.rlike("(?i)recort"), 120).when(kind.rlike("(?i)tentadero|clase"), 90).otherwise(150)
    return F.when(explicit > 0, explicit).otherwise(usual)


def remaining_words(total: Column) -> Column:
    """Minutes, rounded up and never below 0, as "1 día, 2 horas y 3 minutos"."""
    whole = F.greatest(F.lit(0), F.ceil(total)).cast("bigint")
    parts = [(F.floor(whole / 1440), "día"), (F.floor(whole % 1440 / 60), "hora"), (whole % 60, "minuto")]
    said = F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))) for n, w in parts]))
    most = F.size(said)
    return F.when(most == 0, "0 minutos").when(most == 1, F.get(said, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(said, 1, F.greatest(most - 1, F.lit(1))), ", "), F.lit(" y "), F.get(said, most - 1))
    )
