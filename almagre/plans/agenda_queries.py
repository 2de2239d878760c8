"""Composite queries of the agenda: boards, alerts, nearby festejos, reports; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagre.functions import dates, text
from almagre.operators import dedupe, extract, joins
from almagre.plans.relational_queries import _CATEGORY
from almagre.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _latest(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Each festejo by its latest delivery."""
    v = table(spark, sf_dir, "vadetoros").select("id", *cols, "fetchedAt", "loaded_at", "row_id")
    return dedupe.keep(v, ["id"], [C("fetchedAt"), C("loaded_at"), C("row_id")])


_LATEST = "(select * from (select *, row_number() over (partition by id order by fetchedAt desc, loaded_at desc, row_id desc) as k from vadetoros) where k = 1)"
_CLASS = "case " + " ".join(f"when regexp_matches(type, '{p}') then '{x}'" for p, x in _CATEGORY) + " end"
_UTC = r"case when regexp_matches(time, '^\d{1,2}:\d{2}$') then (strptime(date || ' ' || lpad(time, 5, '0'), '%Y-%m-%d %H:%M') at time zone 'Europe/Madrid') at time zone 'UTC' end"


@query(f"""select status, count(*) as n from (select case when u is null then 'unknown' when timestamp '2024-07-20 16:20:00' >= u and timestamp '2024-07-20 16:20:00' < u + interval 150 minute then 'live' when timestamp '2024-07-20 16:20:00' >= u + interval 150 minute then 'finished'
  when epoch(u) - epoch(timestamp '2024-07-20 16:20:00') <= 900 then 'soon' when u::date = date '2024-07-20' then 'today' when u::date = date '2024-07-21' then 'tomorrow' else 'future' end as status from (select {_UTC} as u from {_LATEST})) group by 1""")
def qh_status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many festejos are live, over, soon, today, tomorrow or later at an instant."""
    now = F.lit("2024-07-20 16:20:00").cast("timestamp_ntz")
    status = dates.span_status(dates.to_utc(C("date"), C("time")), F.lit(150), now)
    return _latest(spark, sf_dir, "date", "time").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""with n as (select date, coalesce(nullif(time, ''), '99:99') as t, id from {_LATEST}) select date, t, id from (select *, row_number() over (partition by substring(date, 1, 7) order by date, t, id) as k from n where date >= '2024-01-01') where k = 1""")
def w05_next_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first festejo of each month from a day on."""
    rows = _latest(spark, sf_dir, "date", "time").where("date >= '2024-01-01'").select("date", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")).alias("t"), "id")
    first = F.min(F.struct("date", "t", "id")).alias("r")
    return rows.groupBy(F.substring("date", 1, 7).alias("m")).agg(first).select("r.date", "r.t", "r.id")


@query(f"""select c.id, strftime(cast(date as date), '%Y-%m-%d') as day, {_CLASS.replace('type', 'c.type')} as category from {_LATEST} c where {_CLASS.replace('type', 'c.type')} in ('rejones', 'recortes') and regexp_matches(time, '^\\d{{1,2}}:\\d{{2}}$')
  and not exists (select 1 from lasventas l where l.date = c.date and l.location = c.location)""")
def qf_category_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed festejos of chosen categories that another feed doesn't announce already."""
    rows = _latest(spark, sf_dir, "date", "time", "type", "location").withColumn("category", text.ladder(C("type"), _CATEGORY))
    rows = rows.where(C("category").isin("rejones", "recortes") & C("time").rlike(r"^\d{1,2}:\d{2}$"))
    return rows.join(table(spark, sf_dir, "lasventas").select("date", "location"), ["date", "location"], "left_anti").select("id", C("date").alias("day"), "category")


_LAT, _LON = "36 + ref_id * 37 % 70 / 10.0", "-7 + ref_id * 53 % 90 / 10.0"


@query(f"""with g as (select label, {_LAT} as lat, {_LON} as lon from refvalues where kind = 'place'), d as (select v.id, pow(sin(radians(40.4 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.4)) * pow(sin(radians(-3.7 - lon) / 2), 2) as h
  from {_LATEST} v join g on v.location = g.label) select id, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 3) as km from d where 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) <= 100""")
def qd_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festejos within 100 km of a point: places located first, misses dropped, then joined."""
    places = table(spark, sf_dir, "refvalues").where("kind = 'place'").select(C("label").alias("location"), F.expr(_LAT).alias("lat"), F.expr(_LON).alias("lon"))
    centre = spark.createDataFrame([(40.4, -3.7)], "lat double, lon double")
    near = joins.within_km(places.withColumn("lat", C("lat").cast("double")).withColumn("lon", C("lon").cast("double")), centre, 100).select("location", "km")
    return _latest(spark, sf_dir, "location").join(near, "location").select("id", F.round("km", 3).alias("km"))


@query("""with s as (select feed, file_no, max(delivered) as latest, count(*) as n, count(distinct json_extract_string(payload, '$.id')) as records from rawrecords group by 1, 2),
  p as (select *, lag(n) over (partition by feed order by file_no) as before from s) select feed, count(*) as files, sum(n) as lines, max(latest) as latest, count_if(before is not null and n < before) as shrunk from p group by 1""")
def qi_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines, last delivery and shrunken deliveries of each feed."""
    files = table(spark, sf_dir, "rawrecords").groupBy("feed", "file_no").agg(F.max("delivered").alias("latest"), F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("feed").orderBy("file_no"))
    return files.withColumn("less", F.coalesce(C("n") < before, F.lit(False))).groupBy("feed").agg(
        F.count("*").alias("files"), F.sum("n").alias("lines"), F.max("latest").alias("latest"), F.count_if("less").alias("shrunk")
    )


@query(rf"""with p as (select id, date, location, cast(split_part(time, ':', 1) as int) * 60 + cast(split_part(time, ':', 2) as int) as minute, unnest(list_distinct(participants)) as who from {_LATEST} where regexp_matches(time, '^\d{{1,2}}:\d{{2}}$'))
  select a.id as a_id, b.id as b_id, a.who from p a join p b on a.date = b.date and a.who = b.who and a.id < b.id and a.location <> b.location and abs(a.minute - b.minute) <= 240""")
def qj_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who would stand in two places within four hours."""
    rows = _latest(spark, sf_dir, "date", "time", "location", "participants").select("id", "date", "location", dates.minutes(C("time")).alias("minute"), F.explode(F.array_distinct("participants")).alias("who"))
    return joins.close_pairs(rows, ["date", "who"], "id", "minute", 240, C("a_location") != C("b_location")).select("a_id", "b_id", C("a_who").alias("who"))


@query(f"""with r as (select id, location, type, cast(date as date) as d from {_LATEST} where location <> '') select a.id as old_id, b.id as new_id from r a join r b on a.location = b.location and a.type = b.type and datediff('day', a.d, b.d) between 1 and 21
  qualify row_number() over (partition by a.id order by b.id) = 1""")
def e09_rescheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festejos with one of the same kind at the same place within the three weeks after."""
    rows = _latest(spark, sf_dir, "date", "location", "type").where("location <> ''").select("id", "location", "type", F.to_date("date").alias("d"))
    return joins.moved_dates(rows, ["location", "type"], "d", "id", 21, F.lit(True)).select(C("a_id").alias("old_id"), C("b_id").alias("new_id"))


@query("""select title, date, count(*) as n from (select title, date from canalextremadura union all select 'Boletín', '2025-06-01' union all select 'Boletín', '2025-06-08') where title is not null group by 1, 2""")
def s17_with_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed together with constant programmes on given days."""
    constant = spark.range(1).select(F.lit("Boletín").alias("title"), F.explode(F.array(F.lit("2025-06-01"), F.lit("2025-06-08"))).alias("date"))
    return table(spark, sf_dir, "canalextremadura").select("title", "date").unionByName(constant).where("title is not null").groupBy("title", "date").agg(F.count("*").alias("n"))


@query("""select l_orderkey, cast(floor(l_extendedprice / 20000) as bigint) as col_no, cast(floor(l_quantity / 5 + 0.5) as bigint) as row_no, string_agg(l_returnflag, '' order by l_extendedprice, l_linenumber, l_partkey, l_suppkey) as cell from lineitem group by 1, 2, 3""")
def x14_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned tokens gathered into grid cells, joined in their order: rounded rows, columns by width."""
    tokens = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.floor(C("l_extendedprice") / 20000).alias("col_no"), F.floor(C("l_quantity") / 5 + 0.5).alias("row_no"),
        F.struct("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("token"),
    )
    cell = F.array_join(F.transform(F.array_sort(F.collect_list("token")), lambda t: t["l_returnflag"]), "")
    return tokens.groupBy("l_orderkey", "col_no", "row_no").agg(cell.alias("cell"))


@query("""select row_id, regexp_extract(sourceText, '(\\d{1,2}/\\d{1,2}/\\d{4})', 1) as day, nullif(trim(regexp_extract(sourceText, '(?s)📺(.*?)(?:\\. 🏟|$)', 1)), '') as channel, nullif(trim(regexp_extract(sourceText, 'con reses de (.*?) para ', 1)), '') as breeding,
  len(string_split_regex(nullif(trim(regexp_extract(sourceText, ' para (.*)\\.$', 1)), ''), '\\s*[,;·]\\s*|\\s+[ye]\\s+')) as people from elmuletazo where sourceText is not null""")
def x05_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of each listing's text: day, channel, herd and how many people."""
    src = table(spark, sf_dir, "elmuletazo").where("sourceText is not null")
    line = extract.lineup(C("sourceText"), [r"con reses de (.*?) para "], [r" para (.*)\.$"])
    people = F.regexp_extract("sourceText", r" para (.*)\.$", 1)
    return src.select(
        "row_id", F.regexp_extract("sourceText", r"(\d{1,2}/\d{1,2}/\d{4})", 1).alias("day"), extract.between(C("sourceText"), "📺", r"\. 🏟").alias("channel"),
        line["breeding"].alias("breeding"), F.when(people != "", F.size(F.split(F.trim(people), r"\s*[,;·]\s*|\s+[ye]\s+"))).cast("bigint").alias("people"),
    )
