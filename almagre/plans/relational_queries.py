"""Queries of joins, aggregations, windows, ordering, resolution and quality over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagre.functions import dates, text
from almagre.functions.similarity import filled_score
from almagre.operators import dedupe, extract, joins, quality, resolution
from almagre.sources import readers, sinks
from almagre.session import cut, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
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


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their day and minute of the day."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("minute", F.hour("ts") * 60 + F.minute("ts"))


_EV = "(select *, strftime(ts, '%Y-%m-%d') as day, hour(ts) * 60 + minute(ts) as minute from events)"

# -- scans, unions, fallbacks, sinks ------------------------------------------------------------------


@query("""select feed, count(*) as n, max(delivered) as latest from (select 'elmuletazo' as feed, fetchedAt as delivered from elmuletazo union all select 'lasventas', fetchedAt from lasventas
  union all select 'canalsur', updatedAt from canalsur union all select 'canalextremadura', updatedAt from canalextremadura) group by feed""")
def s04_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds as one table, their time of delivery under one name, counted."""
    parts = [table(spark, sf_dir, f).select(F.lit(f).alias("feed"), C(at).alias("at")) for f, at in (("elmuletazo", "fetchedAt"), ("lasventas", "fetchedAt"), ("canalsur", "updatedAt"), ("canalextremadura", "updatedAt"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("feed").agg(F.count("*").alias("n"), F.max("at").alias("latest"))


@query("select row_id, title from canalsur where type is not null")
def s16_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is empty is replaced by the next one, decided when the query runs."""
    c = table(spark, sf_dir, "canalsur").select("row_id", "title", "type")
    return readers.with_fallback(c.where("type = 'no such type'"), c.where("type is not null")).select("row_id", "title")


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def s07_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of JSON texts, through the variant type."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""select feed, file_no, line_no, json_extract_string(payload, '$.id') as id, json_type(payload, '$.participants') = 'ARRAY' as listed from rawrecords""")
def s22_located_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record's list is a list, whatever else stands there."""
    json = F.try_parse_json("payload")
    kind = F.schema_of_variant(F.try_variant_get(json, "$.participants", "variant"))
    return table(spark, sf_dir, "rawrecords").select("feed", "file_no", "line_no", F.try_variant_get(json, "$.id", "string").alias("id"), kind.startswith("ARRAY").alias("listed"))


@query("select distinct * from (select eventUrl as url from vadetoros union all select eventUrl from lasventas union all select sourceUrl from canalsur) where url is not null")
def so02_distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct addresses of three feeds."""
    parts = [table(spark, sf_dir, f).select(C(c).alias("url")) for f, c in (("vadetoros", "eventUrl"), ("lasventas", "eventUrl"), ("canalsur", "sourceUrl"))]
    return parts[0].union(parts[1]).union(parts[2]).where("url is not null").distinct()


@query("""with f as (select distinct id from vadetoros where fetchedAt = (select min(fetchedAt) from vadetoros)), l as (select distinct id from vadetoros where fetchedAt = (select max(fetchedAt) from vadetoros))
  select id, 'cancel' as action from f where id not in (select id from l) union all select id, 'schedule' from l where id not in (select id from f)""")
def k05_resynchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to cancel and what to schedule to come from the first snapshot to the last."""
    v = table(spark, sf_dir, "vadetoros")
    ends = v.agg(F.min("fetchedAt").alias("first"), F.max("fetchedAt").alias("last"))
    both = v.join(ends, (C("fetchedAt") == C("first")) | (C("fetchedAt") == C("last"))).select("id", (C("fetchedAt") == C("first")).alias("old")).distinct()
    return sinks.resynchronised(both.where("old").select("id"), both.where("not old").select("id"), "id")


# -- joins --------------------------------------------------------------------------------------------


@query(f"""select a.event_id as a_event_id, b.event_id as b_event_id from {_EV} a join {_EV} b on a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id
  and abs(a.minute - b.minute) <= 45 and a.event_type <> b.event_type""")
def j02_close_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on a day within 45 minutes, of different types."""
    pairs = joins.close_pairs(_ev(spark, sf_dir).select("event_id", "user_id", "day", "minute", "event_type"), ["user_id", "day"], "event_id", "minute", 45, C("a_event_type") != C("b_event_type"))
    return pairs.select("a_event_id", "b_event_id")


_SLOT = r"""(select row_id, date, channel, location, cast(split_part(time, ':', 1) as int) * 60 + cast(split_part(time, ':', 2) as int) as minute from lasventas
  where regexp_matches(time, '^\d{1,2}:\d{2}$') and televised and channel is not null)"""


@query(f"""select a.row_id as a_row_id, b.row_id as b_row_id from {_SLOT} a join {_SLOT} b on a.date = b.date and a.channel = b.channel and a.row_id < b.row_id
  and abs(a.minute - b.minute) <= 30 and a.location <> b.location""")
def j04_channel_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcasts of one channel on a day within half an hour, from different places."""
    rows = table(spark, sf_dir, "lasventas").where("televised").select("row_id", "date", "channel", "location", dates.minutes(C("time")).alias("minute"))
    return joins.close_pairs(rows, ["date", "channel"], "row_id", "minute", 30, C("a_location") != C("b_location")).select("a_row_id", "b_row_id")


@query("""with p as (select distinct date, location, unnest(participants) as who, row_id from canalextremadura), q as (select distinct date, channel, unnest(participants) as who, row_id from canalsur)
  select p.row_id as a_row_id, q.row_id as b_row_id, count(*) as people from p join q on p.date = q.date and p.who = q.who group by all""")
def j02_shared_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes of two feeds on the same day with the same people."""
    p = table(spark, sf_dir, "canalextremadura").select("date", F.explode("participants").alias("who"), C("row_id").alias("a_row_id")).distinct()
    q = table(spark, sf_dir, "canalsur").select("date", F.explode("participants").alias("who"), C("row_id").alias("b_row_id")).distinct()
    return p.join(q, ["date", "who"]).groupBy("a_row_id", "b_row_id").agg(F.count("*").alias("people"))


@query("""select a_o_orderkey, b_o_orderkey from (select a.o_orderkey as a_o_orderkey, b.o_orderkey as b_o_orderkey, row_number() over (partition by a.o_orderkey order by b.o_orderkey) as n
  from orders a join orders b on a.o_custkey = b.o_custkey and datediff('day', a.o_orderdate, b.o_orderdate) between 1 and 21 and b.o_totalprice > a.o_totalprice) where n = 1""")
def j03_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the first later, dearer order of the customer within 21 days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return joins.moved_dates(o, ["o_custkey"], "o_orderdate", "o_orderkey", 21, C("b_o_totalprice") > C("a_o_totalprice")).select("a_o_orderkey", "b_o_orderkey")


@query("""select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA'""")
def j05_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation and region; misses drop out."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, C("s_nationkey") == C("n_nationkey")).join(r, C("n_regionkey") == C("r_regionkey")).where("r_name <> 'ASIA'").select("s_suppkey", "n_name", "r_name")


@query("""with p as (select c_custkey, (c_custkey * 37 % 1400) / 10.0 - 70 as lat, (c_custkey * 101 % 3400) / 10.0 - 170 as lon from customer),
  q as (select n_nationkey, (n_nationkey * 53 % 140) - 70.0 as lat, (n_nationkey * 17 % 340) - 170.0 as lon from nation),
  d as (select c_custkey, n_nationkey, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2) as h from p, q)
  select c_custkey, n_nationkey, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 3) as km from d where 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) <= 250""")
def j06_within_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 250 km of a nation's centre, by cells and the great circle."""
    p = table(spark, sf_dir, "customer").select("c_custkey", (C("c_custkey") * 37 % 1400 / 10.0 - 70).alias("lat"), (C("c_custkey") * 101 % 3400 / 10.0 - 170).alias("lon"))
    q = table(spark, sf_dir, "nation").select("n_nationkey", (C("n_nationkey") * 53 % 140 - 70.0).alias("lat"), (C("n_nationkey") * 17 % 340 - 170.0).alias("lon"))
    return joins.within_km(p, q, 250).select("c_custkey", "n_nationkey", F.round("km", 3).alias("km"))


_WANTED = {"channel": ["Canal Ribera", "Tele Dehesa"], "location": ["Madralba (Altozano Real)"], "participants": ["Víctor Gallededor", "Pablo Murciboche"]}
_LABELS = "list_filter([case when channel = 'Canal Ribera' then 'channel: Canal Ribera' end, case when channel = 'Tele Dehesa' then 'channel: Tele Dehesa' end, case when location = 'Madralba (Altozano Real)' then 'location: Madralba (Altozano Real)' end, case when list_contains(participants, 'Víctor Gallededor') then 'participants: Víctor Gallededor' end, case when list_contains(participants, 'Pablo Murciboche') then 'participants: Pablo Murciboche' end], lambda x: x is not null)"


@query(f"select row_id, array_to_string({_LABELS}, '; ') as labels from vadetoros where len({_LABELS}) > 0")
def j07_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festejos with the preferences they meet."""
    found = joins.favourites(table(spark, sf_dir, "vadetoros"), _WANTED, ["participants"])
    return found.where(F.size("matched") > 0).select("row_id", F.array_join("matched", "; ").alias("labels"))


@query("select row_id from lasventas l where exists (select 1 from vadetoros v where v.date = l.date and v.location = l.location)")
def j08_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one feed with a festejo on the same day and place in another."""
    return table(spark, sf_dir, "lasventas").join(table(spark, sf_dir, "vadetoros"), ["date", "location"], "left_semi").select("row_id")


@query("select row_id from elmuletazo e where not exists (select 1 from vadetoros v where v.date = e.date)")
def j09_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one feed on days without any festejo in another."""
    return table(spark, sf_dir, "elmuletazo").join(table(spark, sf_dir, "vadetoros").select("date").distinct(), "date", "left_anti").select("row_id")


_RULES = [(1, "Costa", "coast"), (2, "Sierra", "hills"), (3, "Río", "river"), (4, "Albarrena", "inland")]


@query("select row_id, case when contains(location, 'Costa') then 'coast' when contains(location, 'Sierra') then 'hills' when contains(location, 'Río') then 'river' when contains(location, 'Albarrena') then 'inland' end as label from vadetoros")
def j10_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place's label by the first rule whose term it contains."""
    rules = spark.createDataFrame(_RULES, "rank int, term string, label string")
    return joins.first_rule(table(spark, sf_dir, "vadetoros").select("row_id", "location"), "location", rules).select("row_id", "label")


@query("""select strftime(d, '%Y-%m-%d') as day, count(l.row_id) as n from generate_series((select min(cast(date as date)) from lasventas), (select max(cast(date as date)) from lasventas), interval 1 day) g(d)
  left join lasventas l on cast(l.date as date) = d::date group by 1""")
def j11_calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day, days without any included."""
    rows = table(spark, sf_dir, "lasventas").select(F.to_date("date").alias("d"), "row_id")
    span = rows.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.join(rows, "d", "left").groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(F.count("row_id").alias("n"))


@query("""with a as (select distinct n_regionkey as g, n_nationkey * 400.0 as anchor from nation), p as (select c_custkey, c_nationkey % 5 as g, c_acctbal as x from customer),
  r as (select c_custkey, anchor, row_number() over (partition by c_custkey order by abs(anchor - x), anchor) as n from p join a using (g)) select c_custkey, anchor from r where n = 1""")
def j14_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each balance with the nearest anchor of its group, without pairs."""
    a = table(spark, sf_dir, "nation").select(C("n_regionkey").cast("int").alias("g"), (C("n_nationkey") * 400.0).cast("double").alias("anchor")).distinct()
    p = table(spark, sf_dir, "customer").select("c_custkey", (C("c_nationkey") % 5).cast("int").alias("g"), C("c_acctbal").alias("x"))
    return joins.nearest_value(p, "x", a, "anchor", ["g"]).select("c_custkey", "anchor")


# -- aggregations and deduplication -------------------------------------------------------------------


@query("select count(*) as n, count_if(contentType = 'programa') as programmes, count_if(contentType = 'festejo') as festejos, min(date) as first_day, max(date) as last_day, count(distinct location) as places from vadetoros")
def a01_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a feed and its span of days."""
    return table(spark, sf_dir, "vadetoros").agg(
        F.count("*").alias("n"), F.count_if(C("contentType") == "programa").alias("programmes"), F.count_if(C("contentType") == "festejo").alias("festejos"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct("location").alias("places"),
    )


_CATEGORY = [("(?i)programa", "programmes"), ("(?i)rejon", "rejones"), ("(?i)novillada|becerrada", "novilladas"), ("(?i)recort", "recortes"), ("(?i)corrida", "corridas")]


@query("select category, count(*) as n from (select case " + " ".join(f"when regexp_matches(type, '{p}') then '{x}'" for p, x in _CATEGORY) + " end as category from vadetoros) where category is not null group by 1")
def a02_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festejos per category; what is in none isn't counted."""
    return table(spark, sf_dir, "vadetoros").groupBy(text.ladder(C("type"), _CATEGORY).alias("category")).agg(F.count("*").alias("n")).where("category is not null")


_CHANNELS = ["Canal Ribera", "Tele Dehesa", "Canal Albero", "No such channel"]


@query("""select s as channel, coalesce(n, 0) as n, latest, case when n is null then 'missing' else 'ok' end as status from (select unnest(['Canal Ribera', 'Tele Dehesa', 'Canal Albero', 'No such channel']) as s)
  left join (select channel, count(*) as n, max(fetchedAt) as latest from lasventas group by 1) on s = channel""")
def a04_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected sources with their rows and latest delivery; those without any are missing."""
    return quality.source_health(table(spark, sf_dir, "lasventas"), "channel", "fetchedAt", _CHANNELS)


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1")
def a08_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return dedupe.keep_first(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as n from events) where n = 1")
def a09_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    return dedupe.keep_last(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("""select row_id, id from (select row_id, id, row_number() over (partition by id order by case when coalesce(time, '') <> '' then 4 else 0 end + case when coalesce(breeding, '') <> '' then 4 else 0 end + least(8, coalesce(len(participants), 0) * 2) desc, row_id) as n
  from vadetoros) where n = 1""")
def a10_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest row of each festejo, the first of equals."""
    v = table(spark, sf_dir, "vadetoros").select("row_id", "id", "time", "breeding", "participants")
    return dedupe.keep_best(v, ["id"], filled_score({"time": 4, "breeding": 4}, {"participants": (2, 8)}), "row_id").select("row_id", "id")


@query("""select p_brand, list_sort(list(p_retailprice))[count(*) // 2 + 1] as middle, list_sort(list(p_retailprice))[cast(floor(count(*) * 0.08) as int) + 1] as low from part group by 1""")
def a11_group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median and a low percentile of each group, by rank instead of gathering the group."""
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    ranked = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("p_brand")))
    return ranked.groupBy("p_brand").agg(
        F.max(F.when(C("i") == F.floor(C("n") / 2), C("p_retailprice"))).alias("middle"), F.max(F.when(C("i") == F.floor(C("n") * 0.08), C("p_retailprice"))).alias("low")
    )


@query("select who, count(*) as n, count(distinct date) as days from (select unnest(participants) as who, date from canalextremadura) where who is not null group by 1")
def a15_people_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances and days of each person."""
    return table(spark, sf_dir, "canalextremadura").select(F.explode("participants").alias("who"), "date").where("who is not null").groupBy("who").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"))


@query("""select word, count(*) as n from (select unnest(string_split(trim(regexp_replace(lower(strip_accents("text")), '[^a-z0-9]+', ' ', 'g')), ' ')) as word from documents) where word <> '' group by 1 having count(*) >= 50""")
def a16_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all documents."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text.fold_accents(C("text"))), "[^a-z0-9]+", " ")), " ")
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where("n >= 50")


# -- windows, order, top-k ----------------------------------------------------------------------------


@query(f"""select event_id, sum(turn) over (partition by user_id order by event_id) as day_index from (select event_id, user_id, case when lag(minute) over (partition by user_id order by event_id) < 360 and minute >= 360 then 1 else 0 end as turn from {_EV})""")
def x10_rolled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of a running listing's items by their times alone."""
    return extract.rolled_days(_ev(spark, sf_dir), ["user_id"], "event_id", "minute", 360).select("event_id", "day_index")


@query("""select event_id, lead(ts) over (partition by user_id order by ts, event_id) as until from events""")
def w02_until_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the time of the user's next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lead("ts").over(w).alias("until"))


@query("""select row_id, 'cmm-' || date || '-' || row_number() over (partition by date order by coalesce(nullif(time, ''), '99:99'), row_id) as ordinal from lasventas""")
def w04_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordinal identifier within each day; missing times come last."""
    w = Window.partitionBy("date").orderBy(F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")), "row_id")
    return table(spark, sf_dir, "lasventas").select("row_id", F.concat(F.lit("cmm-"), "date", F.lit("-"), F.row_number().over(w)).alias("ordinal"))


@query("""select channel, min(date) as next_day from canalextremadura where date >= '2025-01-01' and channel is not null group by 1""")
def w06_next_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next day of each channel from a date on."""
    return table(spark, sf_dir, "canalextremadura").where("date >= '2025-01-01' and channel is not null").groupBy("channel").agg(F.min("date").alias("next_day"))


@query("""select c_custkey, revenue, rank() over (order by revenue desc) as position from (select c_custkey, round(coalesce(sum(o_totalprice), 0), 2) as revenue from customer left join orders on o_custkey = c_custkey group by 1)""")
def w07_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by revenue in competition ranking: equal values share a place.

    Places come from the distinct values' running counts, sorted by range partitions; no window over the whole table.
    """
    totals = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), C("c_custkey") == C("o_custkey"), "left")
    totals = cut(totals.groupBy("c_custkey").agg(F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("revenue")))
    values = cut(totals.groupBy("revenue").agg(F.count("*").alias("n")).repartitionByRange(F.desc("revenue")).withColumn("part", F.spark_partition_id()))
    before = values.groupBy("part").agg(F.sum("n").alias("m"))  # one row a partition
    offset = before.select("part", (F.sum("m").over(Window.orderBy("part")) - C("m")).alias("offset"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("revenue"))) - C("n")
    places = values.join(offset, "part").select("revenue", (inner + C("offset") + 1).alias("position"))
    return totals.join(places, "revenue").select("c_custkey", "revenue", "position")


@query("""select row_id, date, time, name from (select row_id, date, time, name from lasventas order by date, coalesce(nullif(time, ''), '99:99'), coalesce(name, ''), row_id)""")
def o01_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agenda in order: day, time (missing ones last), name in Spanish order."""
    t = table(spark, sf_dir, "lasventas")
    return t.orderBy("date", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")), F.collate(F.coalesce("name", F.lit("")), "es"), "row_id").select("row_id", "date", "time", "name")


@query("select doc_id, published from documents where published is not null order by published desc, doc_id limit 40")
def o05_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 latest documents, a top-k report."""
    return table(spark, sf_dir, "documents").where("published is not null").orderBy(F.desc("published"), "doc_id").limit(40).select("doc_id", "published")


@query("""select row_id, strftime(cast(date as date) - 1, '%Y-%m-%d') || ' 20:00' as remind_at from vadetoros where televised and list_contains(participants, 'Víctor Gallededor') and cast(date as date) - 1 > date '2025-01-01'
  order by date, row_id limit 40""")
def o06_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 earliest reminders of a favourite's televised festejos, on the eve at eight."""
    at = dates.eve_at(F.to_date("date"), 20)
    v = table(spark, sf_dir, "vadetoros").where("televised").where(F.array_contains("participants", "Víctor Gallededor"))
    return v.where(F.date_sub(F.to_date("date"), 1) > F.lit("2025-01-01").cast("date")).orderBy("date", "row_id").limit(40).select("row_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("remind_at"))


# -- resolution ---------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    t = table(spark, sf_dir, feed)
    return t.select(
        F.concat(F.lit(f"{feed}:"), C("row_id").cast("string")).alias("rec"), C("row_id").alias("seq"), "date", F.lit("festejo").alias("kind"), "time",
        C("location").alias("place"), "channel", "breeding", "participants",
    )


@query("""with a as (select * from lasventas), b as (select * from canalextremadura) select 'lasventas:' || a.row_id as a_rec, count(distinct b.row_id) as candidates from a join b on a.date = b.date and ((a.location = b.location and a.location <> '') or (a.channel = b.channel and a.channel <> '')) group by 1""")
def e01_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of another feed share a record's day and its place or channel."""
    a, b = table(spark, sf_dir, "lasventas"), table(spark, sf_dir, "canalextremadura")
    a = a.select(F.concat(F.lit("lasventas:"), C("row_id").cast("string")).alias("a_rec"), "date", C("location").alias("p"), C("channel").alias("c"))
    b = b.select("date", C("location").alias("p"), C("channel").alias("c"), C("row_id").alias("b"))
    by = [a.join(b, ["date", k]).where(f"{k} <> ''").select("a_rec", "b") for k in ("p", "c")]
    return by[0].unionByName(by[1]).groupBy("a_rec").agg(F.countDistinct("b").alias("candidates"))


@query()
def e02_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of one feed with its best match in another."""
    return resolution.best_matches(_records(spark, sf_dir, "lasventas"), _records(spark, sf_dir, "vadetoros"))


@query()
def e10_first_match_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festejos of a day, place and type that share half their people or have nearly the same breeding, clustered in order."""
    types = table(spark, sf_dir, "vadetoros").select(C("row_id").alias("seq"), C("type").alias("kind"))
    return resolution.same_event_clusters(_records(spark, sf_dir, "vadetoros").drop("kind").join(types, "seq"))


@query("""select id, first(time order by s desc, row_id) filter (coalesce(time, '') <> '') as time, first(breeding order by s desc, row_id) filter (coalesce(breeding, '') <> '') as breeding, count(*) as members
  from (select id, row_id, breeding, time, case when coalesce(time, '') <> '' then 4 else 0 end + case when coalesce(breeding, '') <> '' then 4 else 0 end as s from vadetoros) group by 1""")
def e04_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per festejo: each field from its fullest delivery that has it."""
    v = table(spark, sf_dir, "vadetoros").select("id", C("row_id").alias("seq"), "time", "breeding")
    return resolution.survivors(v, "id", filled_score({"time": 4, "breeding": 4}, {}), ["time", "breeding"])


# -- quality ------------------------------------------------------------------------------------------


@query(r"""select row_id, unnest(list_filter([case when not coalesce(regexp_matches(date, '^\d{4}-\d{2}-\d{2}$'), false) then 'date' end, case when not coalesce(regexp_matches(time, '^\d{2}:\d{2}$'), false) then 'time' end,
  case when not coalesce(channel <> '', false) then 'channel' end, case when not coalesce(len(participants) > 0, false) then 'participants' end], lambda x: x is not null)) as violation from elmuletazo""")
def d01_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks each row fails, a row each."""
    checks = {"date": C("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "time": C("time").rlike(r"^\d{2}:\d{2}$"), "channel": C("channel") != "", "participants": F.size("participants") > 0}
    return quality.violations(table(spark, sf_dir, "elmuletazo"), "row_id", checks)


@query("""with c as (select feed, file_no, count(*) as n from rawrecords group by 1, 2), p as (select *, lag(n) over (partition by feed order by file_no) as before from c)
  select feed, file_no, n, before from p where before >= 10 and n < floor(before * 1.0)""")
def d05_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with fewer lines than the one before."""
    counts = table(spark, sf_dir, "rawrecords").groupBy("feed", "file_no").agg(F.count("*").alias("n"))
    return quality.shrunk(counts, ["feed"], "file_no", 10, 1.0)


# -- what a user runs ---------------------------------------------------------------------------------


@query("""select id, coalesce(nullif(time, ''), '99:99') as at, location from (select *, row_number() over (partition by id order by fetchedAt desc, loaded_at desc, row_id desc) as n from vadetoros) where n = 1 and date = '2025-08-15'""")
def qb_day_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The festejos of a day by their latest delivery."""
    v = table(spark, sf_dir, "vadetoros").select("id", "date", "time", "location", "fetchedAt", "loaded_at", "row_id")
    latest = dedupe.keep(v, ["id"], [C("fetchedAt"), C("loaded_at"), C("row_id")])
    return latest.where("date = '2025-08-15'").select("id", F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")).alias("at"), "location")


@query("""select date, category, count(*) as n from (select date, case """ + " ".join(f"when regexp_matches(type, '{p}') then '{x}'" for p, x in _CATEGORY) + """ end as category from (select *, row_number() over (partition by id order by fetchedAt desc, loaded_at desc, row_id desc) as k from vadetoros) where k = 1) where category is not null group by 1, 2""")
def qc_days_and_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Festejos per day and category, each by its latest delivery."""
    v = table(spark, sf_dir, "vadetoros").select("id", "date", "type", "fetchedAt", "loaded_at", "row_id")
    latest = dedupe.keep(v, ["id"], [C("fetchedAt"), C("loaded_at"), C("row_id")])
    return latest.groupBy("date", text.ladder(C("type"), _CATEGORY).alias("category")).agg(F.count("*").alias("n")).where("category is not null")


@query("""with e as (select 'elmuletazo' as feed, row_id, date, time, channel, location as place, breeding, participants, fetchedAt as delivered from elmuletazo union all select 'lasventas', row_id, date, time, channel, location, breeding, participants, fetchedAt from lasventas
  union all select 'canalsur', row_id, date, time, channel, location, breeding, participants, updatedAt from canalsur), k as (select *, row_number() over (partition by date, time, place order by len(coalesce(participants, [])) desc, delivered desc, feed desc, row_id desc) as n from e where date is not null and place <> '')
  select feed, row_id, date, time, place from k where n = 1""")
def qa_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agenda of three feeds: the fullest record of each day, time and place."""
    parts = [
        table(spark, sf_dir, f).select(F.lit(f).alias("feed"), "row_id", "date", "time", C("location").alias("place"), F.coalesce(F.size("participants"), F.lit(0)).alias("people"), C(at).alias("at"))
        for f, at in (("elmuletazo", "fetchedAt"), ("lasventas", "fetchedAt"), ("canalsur", "updatedAt"))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("date is not null and place <> ''")
    return dedupe.keep(rows, ["date", "time", "place"], [C("people"), C("at"), C("feed"), C("row_id")]).select("feed", "row_id", "date", "time", "place")


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1999-06-01' group by 1, 2""")
def h01_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the largest table by two flags."""
    t = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1999-06-01'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def h02_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by the customers' nation: sums per order before the joins."""
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(C("l_extendedprice") * (1 - C("l_discount"))).alias("r"))
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    per_customer = per_order.join(o, C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    return per_customer.join(c, C("o_custkey") == C("c_custkey")).join(n, C("c_nationkey") == C("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


# -- streams ------------------------------------------------------------------------------------------


@query("select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc) as n from events) where n = 1")
def t01_folded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, folded from a stream of files into a retained table."""
    import uuid

    from almagre.streaming.feeds import deliveries, fold_latest

    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    whole = [p.name for p in _folders(spark, f"{sf_dir}/events.parquet")] != ["events.parquet"]  # a folder of files, or one file
    path, only = (f"{sf_dir}/events.parquet", "*") if whole else (sf_dir, "events.parquet")
    stream = deliveries(spark, path, source.schema.simpleString()[7:-1].replace(":", " "), files_per_trigger=100, only=only)
    fold_latest(stream, ["user_id"], "ts", f"{place}/table", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    numbers = [int(p.name) for p in _folders(spark, f"{place}/table")]
    return spark.read.parquet(f"{place}/table/{max(numbers)}").select("user_id", "event_id", "ts", "event_type")


def _folders(spark: SparkSession, path: str) -> list:
    """The entries of a folder, as paths with a name."""
    from pathlib import PurePosixPath

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [PurePosixPath(s.getPath().toString()) for s in fs.listStatus(at)]
