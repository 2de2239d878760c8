"""Queries over pages, answers, grids, dates and what a user keeps, with their SQL. Pages are made of the tables' own columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagre.functions import arrays, dates, labels, pages, places, similarity, text
from almagre.operators import extract, joins, listings, quality
from almagre.plans.agenda_queries import _LATEST, _UTC, _latest
from almagre.plans.function_queries import _normal, _squeezed
from almagre.plans.label_queries import fuzzy_sql
from almagre.plans.relational_queries import _CATEGORY
from almagre.session import shared_folder, table
from almagre.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def _column(name: str, source: str, expression: Callable[[], Column], sql: str, key: str = "row_id") -> None:
    """Registers ``(key, result)`` of an expression over a table; ``sql`` is the same expression."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).select(key, expression().alias("result"))
    SQL[name] = f"select {key}, {sql} as result from {source}"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- pages and answers --------------------------------------------------------------------------------------
_escaped = lambda c: text.html_escaped(F.coalesce(c, F.lit("")))
_json = lambda c: F.to_json(F.struct(c.alias("articleBody")))
_page = lambda: F.concat(
    F.lit("<html><head><title> "), _escaped(C("title")), F.lit(" &#xE9;&#9999999; </title><link href='/d/"), C("doc_id").cast("string"), F.lit("' rel='canonical'><script type=\"application/ld+json\">{broken</script><script type=\"application/ld+json\">{\"@graph\":[{\"a\":1},"),
    _json(C("text")), F.lit("]}</script></head><body><div class=\"x lead y\">"), _escaped(C("title")), F.lit("</div><div class='lead'>no</div></body></html>"),
)
_flat = lambda x: rf"trim(regexp_replace({x}, '[\s\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_column("f15d_article_body", "documents", lambda: pages.article_body(_page()), f"nullif({_flat(chr(34) + 'text' + chr(34))}, '')", "doc_id")
_column("f15c_page_title", "documents", lambda: pages.page_title(_page()), f"{_flat('coalesce(title, ' + chr(39) * 2 + ')' + ' || ' + chr(39) + ' é�' + chr(39))}", "doc_id")
_column("f15c_canonical", "documents", lambda: pages.resolved_url(F.lit("https://feed.example/a/b?x=1"), pages.canonical_link(_page())), "'https://feed.example/d/' || doc_id", "doc_id")
_column("f15e_class_content", "documents", lambda: text.decoded_entities(pages.class_content(_page(), "lead", "div")), "coalesce(title, '')", "doc_id")
_column("f15f_quoted", "vadetoros", lambda: F.regexp_replace("location", pages.quoted("(Tierra Parda)"), "[tp]"), "replace(location, '(Tierra Parda)', '[tp]')")
_column("f15b_resolved", "vadetoros", lambda: pages.resolved_url(C("sourceUrl"), F.concat(F.lit("../x/"), C("id"))), "regexp_replace(regexp_replace(sourceUrl, '[?#].*$', ''), '([^/])/[^/]*$', '\\1') || '/../x/' || id")
_rss = lambda: F.concat(F.lit("<rss><item><title>a</title></item><item><title>"), _escaped(C("title")), F.lit("</title><link>"), C("sourceUrl"), F.lit("</link></item><item><title>z</title><link>l</link></item></rss>"))
_column("s14_feed_items", "canalextremadura", lambda: F.array_join(F.transform(pages.feed_items(_rss(), 1), lambda i: F.concat_ws("|", i["title"], i["link"])), ";"), f"case when {_flat('coalesce(title, ' + chr(39) * 2 + ')')} = '' or coalesce(sourceUrl, '') = '' then case when sourceUrl is null then null else 'z|l' end else {_flat('title')} || '|' || sourceUrl end")
_map = lambda: F.concat(F.lit("<urlset><url><loc>"), C("eventUrl"), F.lit("</loc><lastmod>"), C("date"), F.lit("</lastmod><news:title><![CDATA["), _escaped(C("name")), F.lit("]]></news:title></url><url><loc>https://feed.example/none</loc></url></urlset>"))
_column("s13_sitemap", "lasventas", lambda: F.array_join(F.transform(pages.sitemap_items(_map(), "feed", "feria|corrida"), lambda i: F.concat_ws("|", i["title"], i["link"], i["published"])), ";"), f"case when eventUrl is null or date is null or coalesce(name, '') is null then null when contains(eventUrl, 'feed') and regexp_matches(lower(coalesce(nullif({_flat('name')}, ''), eventUrl) || ' ' || eventUrl), 'feria|corrida') then coalesce(nullif({_flat('name')}, ''), eventUrl) || '|' || eventUrl || '|' || date else '' end")
_column("s12_monthly_names", "lasventas", lambda: F.array_join(pages.monthly_names(F.to_date("date"), "'contents_'yyyy'_'MM'.xml'"), " "), "array_to_string(list_transform([0, 1, 2], lambda i: strftime(date_trunc('month', cast(date as date)) - to_months(i::int), 'contents_%Y_%m.xml')), ' ')")
_column("s11_two_tiers", "vadetoros", lambda: text.first_filled(F.get(text.links(F.concat(F.lit("<a href='"), "eventUrl", F.lit("'>")), r"\.pdf"), 0), F.get(text.links(F.concat(F.lit("<a href='"), "sourceUrl", F.lit("'>")), "feed"), 0)), "coalesce(case when contains(eventUrl, '.pdf') then eventUrl end, case when contains(sourceUrl, 'feed') then sourceUrl end)")
_answer = lambda: F.try_parse_json(F.to_json(F.struct(F.when(C("row_id") % 3 == 0, F.lit("no list")).alias("contents"), F.when(C("row_id") % 2 == 0, C("participants")).alias("items"), C("participants").alias("children"))))
_column("s22_array_located", "vadetoros", lambda: F.array_join(F.try_variant_get(pages.located_array(_answer()), "$", "array<string>"), "|"), "array_to_string(participants, '|')")
_people = lambda: F.try_parse_json(F.concat(F.lit("["), F.array_join(F.transform("participants", lambda p, i: F.when(i % 2 == 0, F.concat(F.lit('{"name":"'), p, F.lit('"}'))).otherwise(F.concat(F.lit('" '), p, F.lit('"')))), ","), F.lit(",{},null,7]")))
_column("f87_flat_names", "vadetoros", lambda: F.array_join(pages.flat_names(_people()), "|"), "coalesce(array_to_string(participants, '|'), '')")
_column("s21_stored_numbers", "vadetoros", lambda: F.array_join(F.transform(pages.integers_of(F.concat(F.lit("["), C("row_id").cast("string"), F.lit(',"x",1.5,'), (C("row_id") * 7).cast("string"), F.when(C("row_id") % 5 == 0, "").otherwise("]"))), lambda x: x.cast("string")), ","), "case when row_id % 5 = 0 then '' else row_id || ',' || row_id * 7 end")
_column("s21_alert_settings", "vadetoros", lambda: F.concat_ws("|", F.array_join(pages.alert_settings(F.when(C("row_id") % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(C("participants").alias("categories"), F.when(C("row_id") % 2 == 0, C("row_id").cast("string")).otherwise("soon").alias("minutesBefore")))))["categories"], ","), pages.alert_settings(F.when(C("row_id") % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(C("participants").alias("categories"), F.when(C("row_id") % 2 == 0, C("row_id").cast("string")).otherwise("soon").alias("minutesBefore")))))["minutes"].cast("string")), "case when row_id % 4 = 0 then '|30' else coalesce(array_to_string(participants, ','), '') || '|' || case when row_id % 2 = 0 then row_id else 30 end end")
_column("x04_entry", "vadetoros", lambda: F.concat_ws("|", pages.entry(F.concat("location", F.lit(" - "), "type", F.lit(" - "), F.coalesce("breeding", F.lit(""))), "(?i)publicidad")["place"], pages.entry(F.concat("location", F.lit(" - "), "type", F.lit(" - "), F.coalesce("breeding", F.lit(""))), "(?i)publicidad")["description"]), rf"""case when location is null or type is null or {_squeezed('location')} = '' then '' else (select case when length(t) < 12 or strpos(t, ' - ') = 0 or length(substring(t, strpos(t, ' - ') + 3)) < 8 then '' else trim(regexp_extract(t, '^(.*?)\s[-–—]\s', 1)) || '|' || regexp_extract(t, '^.*?\s[-–—]\s+(.*)$', 1) end from (select {_squeezed("location || ' - ' || type || ' - ' || coalesce(breeding, '')")} as t)) end""")
_column("x13_cell_title", "canalextremadura", lambda: pages.cell_title(F.concat(F.lit("NOTICIAS EXN2 toros "), F.coalesce("location", F.lit("")), F.lit(" - directo")), ["EXN2", "EXN", "CEX"], [("tierra de toros", "Tierra de Toros")], "toros"), f"'TOROS – ' || case when {_squeezed('coalesce(location, ' + chr(39) * 2 + ')')} = '' then 'directo' else {_squeezed('coalesce(location, ' + chr(39) * 2 + ')')} || ' – directo' end")


@query("""select item_id, name, published from (select row_id as item_id, name, published, date from onetoro where coalesce(name, '') <> '' and row_id % 3 <> 0)""")
def x16_api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of an answer's items: of one kind, with a name."""
    t = table(spark, sf_dir, "onetoro")
    kind = F.when(C("row_id") % 3 == 0, "Folder").otherwise("Video")
    raw = F.try_parse_json(F.to_json(F.struct(kind.alias("itemType"), C("row_id").alias("_id"), F.when(C("row_id") % 2 == 0, C("name")).alias("name"), F.struct(C("name").alias("name")).alias("analytics"), C("published").alias("published"))))
    get = lambda p, kind="string": F.try_variant_get("item", p, kind)
    named = text.first_filled(get("$.name"), get("$.analytics.name"))
    return t.select(raw.alias("item")).where(get("$.itemType") == "Video").select(get("$._id", "bigint").alias("item_id"), named.alias("name"), get("$.published", "boolean").alias("published")).where("name is not null")


@query(f"select row_id, case when coalesce({_squeezed('name')}, '') = '' then '' else {_squeezed('name')} || ' · ' end || 'a b · ' || coalesce(array_to_string(list_filter(list_transform(participants, lambda z: {_squeezed('z')}), lambda z: z <> ''), ' · '), '') as texts from onetoro")
def f15g_public_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of nested answers, without those under private keys."""
    t = table(spark, sf_dir, "onetoro").select("row_id", F.to_json(F.struct("name", C("slug").alias("URL"), F.struct(F.lit(" a  b ").alias("x"), C("sourceUrl").alias("href")).alias("more"), "participants"))
                                               .alias("json"))
    found = pages.public_texts(t, "row_id", "json")
    joined = F.array_join("texts", " · ")
    return found.select("row_id", F.when(joined.endswith("a b"), F.concat(joined, F.lit(" · "))).otherwise(joined).alias("texts"))


@query(r"""select doc_id, len(regexp_extract_all(lower("text"), 'festejo|corrida')) as words, "text" is not null and regexp_matches(lower("text"), 'emite|retransmi') as confirmed from documents where regexp_matches(lower("text"), 'emite|retransmi') and regexp_matches(lower("text"), 'festejo|corrida')""")
def x15_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by their body alone that confirm a broadcast of an event."""
    body = F.lower(pages.article_body(_page()))
    t = table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).where(C("body").rlike("emite|retransmi") & C("body").rlike("festejo|corrida"))
    return t.select("doc_id", F.size(F.regexp_extract_all("body", F.lit("(festejo|corrida)"), F.lit(1))).cast("bigint").alias("words"), F.lit(True).alias("confirmed"))


# -- grids ----------------------------------------------------------------------------------------------------
_heads = lambda: F.concat(F.lit("<b>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.get(F.array(*map(F.lit, listings.WEEKDAYS)), F.dayofweek(F.date_add(F.to_date("date"), i)) - 1), F.lit(" "), F.lpad(F.dayofmonth(F.date_add(F.to_date("date"), i)).cast("string"), 2, "0"))), " "), F.lit(" lunes 40</b>"))
_column("x09_day_headers", "lasventas", lambda: F.array_join(F.transform(listings.day_headers(_heads()), lambda h: F.concat_ws("-", h["weekday"].cast("string"), h["day"].cast("string"))), " "), "array_to_string(list_transform(range(0, 10), lambda i: dayofweek(cast(date as date) + i::int) || '-' || day(cast(date as date) + i::int)), ' ') || ' 1-40'")
_column("f49b_header_dates", "lasventas", lambda: F.array_join(F.transform(listings.header_dates(F.slice(listings.day_headers(_heads()), 1, 10), F.date_add(F.to_date("date"), 9)), dates.iso_day), " "), "array_to_string(list_transform(range(0, 10), lambda i: strftime(cast(date as date) + i::int, '%Y-%m-%d')), ' ')")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as tokens of a page each: seven headers, times beside them, words by price and quantity."""
    line = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("page"), (C("l_linenumber") + 100).alias("pos"), (C("l_extendedprice") % 700).alias("x"), (C("l_quantity") * 10).alias("y"), F.lit(4.0).alias("width"), F.concat("l_returnflag", C("l_linenumber").cast("string")).alias("text"))
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("page"))
    heads = orders.select("page", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select("page", C("i").alias("pos"), (C("i") * 100 + 48.0).alias("x"), F.lit(600.0).alias("y"), F.lit(4.0).alias("width"), F.concat(F.get(F.array(*map(F.lit, listings.WEEKDAYS)), (C("i") + 1) % 7), F.lit(" 3")).alias("text"))
    times = orders.select("page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("page", (C("i") + 50).alias("pos"), F.lit(-40.0).alias("x"), (C("i") * 100 + 3.0).alias("y"), F.lit(4.0).alias("width"), F.concat((C("i") + 10).cast("string"), F.lit(":30")).alias("text"))
    return line.unionByName(heads).unionByName(times)


@query("""with t as (select l_orderkey as page, l_linenumber + 100 as pos, l_extendedprice % 700 as x, l_quantity * 10 as y, l_returnflag || l_linenumber as txt from lineitem),
  c as (select *, (select i from range(0, 7) r(i) order by abs(i * 100 + 50.0 - (x + 2)), i limit 1) as column_no from t),
  k as (select page, pos, column_no, y from c where txt like 'R%')
  select k.page, k.pos, k.column_no, (select (i + 10) || ':30' from range(0, 6) r(i) order by abs(i * 100 + 3.0 - k.y), i desc limit 1) as time, string_agg(c.txt, ' ' order by -floor(c.y / 2), c.x, c.pos) as "text"
  from k join c on c.page = k.page and c.column_no = k.column_no and abs(c.y - k.y) <= 45 group by k.page, k.pos, k.column_no, k.y""")
def x14_grid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around each keyword of a positioned page: its column, the nearest time, the cell's words in reading order."""
    return listings.grid_events(_tokens(spark, sf_dir), ["page"], "^R").select("page", "pos", C("column_no").cast("bigint").alias("column_no"), "time", "text")


# -- dates ------------------------------------------------------------------------------------------------------
_column("f33_published_year", "vadetoros", lambda: dates.iso_day(dates.published_year(F.concat_ws("/", F.dayofmonth(F.to_date("date")), F.month(F.to_date("date"))), F.to_date("fetchedAt"))), "strftime((select case when s < cast(fetchedAt as date) - 45 then try_cast((year(fetchedAt) + 1) || strftime(cast(date as date), '-%m-%d') as date) else s end from (select try_cast(year(fetchedAt) || strftime(cast(date as date), '-%m-%d') as date) as s)), '%Y-%m-%d')")
_column("f33_year_of", "onetoro", lambda: dates.year_of(C("name"), F.lit("2021-05-01").cast("date")), r"coalesce(list_filter(list_transform(regexp_extract_all(name, '\d{4}'), lambda y: y::int), lambda y: y >= 2021)[1], 2021)")
_column("f34b_placed_dates", "elmuletazo", lambda: F.array_join(F.transform(dates.dates_with_places(C("sourceText")), lambda d: F.concat_ws("@", d["text"], d["start"].cast("string"))), " "), r"case when sourceText is null then null else coalesce(nullif(regexp_extract(sourceText, '\d{1,2}/\d{1,2}/\d{4}'), '') || '@' || (strpos(sourceText, regexp_extract(sourceText, '\d{1,2}/\d{1,2}/\d{4}')) - 1), '') end")
_column("f36_spoken_time", "vadetoros", lambda: dates.spoken_time(F.concat(F.lit("El festejo comienza a las "), F.substring(F.lpad(F.trim("time"), 5, "0"), 1, 2), F.lit(" en punto"))), r"case when regexp_matches(lpad(trim(time), 5, '0'), '^([01]\d|2[0-3])') then substring(lpad(trim(time), 5, '0'), 1, 2) || ':00' end")
_column("f39_day_gap", "vadetoros", lambda: dates.day_gap(F.to_date("date"), F.when(C("row_id") % 3 > 0, F.to_date("fetchedAt"))), "case when row_id % 3 > 0 then coalesce(abs(datediff('day', cast(date as date), cast(fetchedAt as date)))::double, 'inf'::double) else 'inf'::double end")
_column("f41c_user_days", "vadetoros", lambda: F.datediff(dates.in_zone(dates.to_utc(C("date"), C("time")), "Asia/Tokyo"), dates.in_zone(F.lit("2024-07-20 16:20:00").cast("timestamp_ntz"), "Asia/Tokyo")), f"datediff('day', ((timestamp '2024-07-20 16:20:00' at time zone 'UTC') at time zone 'Asia/Tokyo')::date, ((({_UTC}) at time zone 'UTC') at time zone 'Asia/Tokyo')::date)")
_column("f41d_weekday", "vadetoros", lambda: dates.weekday_number(F.to_date("date")), "dayofweek(cast(date as date))")
_column("f43_said_duration", "vadetoros", lambda: dates.duration(C("row_id") % 4 * 10, C("contentType"), C("type")), "case when row_id % 4 > 0 then row_id % 4 * 10 when contentType = 'programa' then 60 when regexp_matches(type, '(?i)recort') then 120 when regexp_matches(type, '(?i)tentadero|clase') then 90 else 150 end")
_d, _h, _m = "(row_id % 5000 // 1440)", "(row_id % 5000 % 1440 // 60)", "(row_id % 5000 % 60)"
_said = lambda n, w: f"case when {n} > 0 then {n} || ' {w}' || case when {n} = 1 then '' else 's' end end"
_column("f45_remaining_words", "vadetoros", lambda: dates.remaining_words(C("row_id") % 5000 - 0.5), f"(select case when len(l) = 0 then '0 minutos' when len(l) = 1 then l[1] else array_to_string(l[1:len(l) - 1], ', ') || ' y ' || l[len(l)] end from (select list_filter([{_said(_d, 'día')}, {_said(_h, 'hora')}, {_said(_m, 'minuto')}], lambda z: z is not null) as l))")


# -- what a user sees and keeps ---------------------------------------------------------------------------------
@query(f"""with d as (select date, id, {_UTC} as starts, row_number() over (partition by date order by coalesce(nullif(time, ''), '99:99'), id) - 1 as i from {_LATEST} where date is not null)
  select date, coalesce(min(case when starts >= cast(date || ' 16:00:00' as timestamp) then i end), max(case when starts is not null then i end), 0) as place from d group by 1""")
def w05_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place in each day's agenda of the first event not before four in the afternoon (UTC); else of the last timed one; else 0."""
    order = Window.partitionBy("date").orderBy(F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99")), "id")
    d = _latest(spark, sf_dir, "date", "time").where("date is not null").withColumns({"i": F.row_number().over(order) - 1, "at_": dates.to_utc(C("date"), C("time"))})
    late = F.min(F.when(C("at_") >= F.concat("date", F.lit(" 16:00:00")).cast("timestamp_ntz"), C("i")))
    return d.groupBy("date").agg(F.coalesce(late, F.max(F.when(C("at_").isNotNull(), C("i"))), F.lit(0)).cast("bigint").alias("place"))


@query(f"select id, strftime(u - interval 45 minute, '%Y-%m-%d %H:%M') as notify_at from (select id, {_UTC} as u from {_LATEST}) where u - interval 45 minute > timestamp '2024-07-20 16:20:00'")
def qg_manual_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that may still be set, 45 minutes before: a start that is known and a moment that isn't over."""
    at = dates.before(dates.to_utc(C("date"), C("time")), F.lit(45))
    return _latest(spark, sf_dir, "date", "time").withColumn("at_", at).where(C("at_") > F.lit("2024-07-20 16:20:00").cast("timestamp_ntz")).select("id", F.date_format("at_", "yyyy-MM-dd HH:mm").alias("notify_at"))


@query(f"select id, strftime(u - interval 30 minute, '%Y-%m-%d %H:%M') as notify_at from (select id, {_UTC} as u, type from {_LATEST}) where u - interval 30 minute > timestamp '2024-07-20 16:20:00' and regexp_matches(type, '(?i)rejon|recort') order by u, id limit 20")
def o07_category_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 earliest alerts of chosen kinds, a top-k report."""
    at = dates.before(dates.to_utc(C("date"), C("time")), F.lit(30))
    rows = _latest(spark, sf_dir, "date", "time", "type").where(C("type").rlike("(?i)rejon|recort")).withColumn("at_", at).where(C("at_") > F.lit("2024-07-20 16:20:00").cast("timestamp_ntz"))
    return rows.orderBy("at_", "id").limit(20).select("id", F.date_format("at_", "yyyy-MM-dd HH:mm").alias("notify_at"))


_GEO = "(select label, 36 + ref_id * 37 % 70 / 10.0 as lat, -7 + ref_id * 53 % 90 / 10.0 as lon from refvalues where kind = 'place' and ref_id % 4 > 0)"


@query(f"""select location, n, lat is not null as found from (select location, count(*) as n from {_LATEST} where location <> '' group by 1) l left join {_GEO} g on g.label = l.location""")
def s20_geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place once, looked up in what is known; misses stay to be asked for, and aren't kept as answers."""
    known = table(spark, sf_dir, "refvalues").where("kind = 'place' and ref_id % 4 > 0").select(C("label").alias("location"), F.lit(True).alias("found"))
    asked = _latest(spark, sf_dir, "location").where("location <> ''").groupBy("location").agg(F.count("*").alias("n"))
    return asked.join(known, "location", "left").select("location", "n", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"""with d as (select v.id, date, pow(sin(radians(40.4 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.4)) * pow(sin(radians(-3.7 - lon) / 2), 2) as h from {_LATEST} v join {_GEO} g on v.location = g.label where date between '2024-06-01' and '2025-06-01')
  select id, date, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 3) as km from d where 2 * 6371 * atan2(sqrt(h), sqrt(1 - h)) <= 250""")
def o04_nearby_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a window of days within 250 km, by day, then distance."""
    known = table(spark, sf_dir, "refvalues").where("kind = 'place' and ref_id % 4 > 0").select(C("label").alias("location"), F.expr("36 + ref_id * 37 % 70 / 10.0").cast("double").alias("lat"), F.expr("-7 + ref_id * 53 % 90 / 10.0").cast("double").alias("lon"))
    km = similarity.haversine(C("lat"), C("lon"), F.lit(40.4), F.lit(-3.7))
    near = known.withColumn("km", km).where("km <= 250").select("location", "km")
    rows = _latest(spark, sf_dir, "date", "location").where("date between '2024-06-01' and '2025-06-01'").join(near, "location")
    return rows.orderBy("date", "km", "id").select("id", "date", F.round("km", 3).alias("km"))


@query("select 'a' as section, count(distinct channel) as n from lasventas where channel <> '' union all select 'b', count(distinct location) from lasventas where location <> '' union all select 'all', (select count(distinct channel) from lasventas where channel <> '') + (select count(distinct location) from lasventas where location <> '')")
def a14_favourite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many preferences each section of a user's list has, and all."""
    t = table(spark, sf_dir, "lasventas")
    kept = t.agg(F.collect_set(F.nullif("channel", F.lit(""))).alias("a"), F.collect_set(F.nullif("location", F.lit(""))).alias("b"))
    rows = F.array(F.struct(F.lit("a").alias("section"), F.size("a").cast("bigint").alias("n")), F.struct(F.lit("b").alias("section"), F.size("b").cast("bigint").alias("n")), F.struct(F.lit("all").alias("section"), (F.size("a") + F.size("b")).cast("bigint").alias("n")))
    return kept.select(F.inline(rows))


@query("select distinct category from (select date, case " + " ".join(f"when regexp_matches(type, '{p}') then '{x}'" for p, x in _CATEGORY) + f" end as category from {_LATEST}) where date = (select max(date) from lasventas where date in (select date from vadetoros)) and category is not null")
def j12_categories_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of the active day: the last one that two feeds have."""
    day = table(spark, sf_dir, "lasventas").join(table(spark, sf_dir, "vadetoros").select("date"), "date", "left_semi").agg(F.max("date").alias("date"))
    return _latest(spark, sf_dir, "date", "type").join(day, "date").select(text.ladder(C("type"), _CATEGORY).alias("category")).where("category is not null").distinct()


@query(r"select row_id from elmuletazo where coalesce(date, '') <> '' and coalesce(location, '') <> '' and coalesce(channel, '') <> '' and len(participants) > 0")
def p01_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events that say all they must."""
    whole = [labels.filled(C(c)) for c in ("date", "location", "channel")] + [F.coalesce(F.size("participants"), F.lit(0)) > 0]
    t = table(spark, sf_dir, "elmuletazo")
    for w in whole:
        t = t.where(w)
    return t.select("row_id")


@query(r"select row_id, regexp_matches(date, '^\d{4}-\d{2}-\d{2}$') and date < '2022-06-01' as over from lasventas")
def p02_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's day is over."""
    return table(spark, sf_dir, "lasventas").select("row_id", (C("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (C("date") < "2022-06-01")).alias("over"))


@query("""with a as (select 'lasventas' as feed, fetchedAt as dt from lasventas union all select 'canalsur', updatedAt from canalsur union all select 'canalextremadura', updatedAt from canalextremadura union all select 'elmuletazo', fetchedAt from elmuletazo union all select 'vadetoros', fetchedAt from vadetoros union all select 'onetoro', fetchedAt from onetoro),
  s as (select unnest(['lasventas', 'canalsur', 'canalextremadura', 'elmuletazo', 'vadetoros', 'onetoro', 'cmm']) as feed)
  select s.feed, count(dt) as n, strftime(max(dt), '%Y-%m-%d %H:%M:%S') as latest, case when count(dt) = 0 then 'error' else 'ok' end as status, true as degraded from s left join a on a.feed = s.feed group by 1""")
def a04_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected feeds with rows, latest delivery and status; degraded if one isn't ok."""
    feeds = ("lasventas", "canalsur", "canalextremadura", "elmuletazo", "vadetoros", "onetoro")
    every = readers.all_sources({f: table(spark, sf_dir, f) for f in feeds})
    health = quality.source_health(every, "feed", "at", [*feeds, "cmm"]).withColumn("status", F.when(C("status") == "ok", "ok").otherwise("error"))
    bad = health.agg(F.bool_or(C("status") != "ok").alias("degraded"))
    return health.crossJoin(F.broadcast(bad)).select("feed", "n", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), "status", "degraded")


@query("select place, count(*) as n from (select case when contains(lower(strip_accents(location)), 'madralba') then 'madralba' else 'other' end as place from vadetoros where location is not null) group by 1")
def s04_canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by whether a place is one town, through its key."""
    key = places.canonical_place(C("location"))
    return table(spark, sf_dir, "vadetoros").where("location is not null").groupBy(F.when(F.contains(key, F.lit("madralba")), "madralba").otherwise("other").alias("place")).agg(F.count("*").alias("n"))


_SLOTS = "(select event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') as day, hour(ts) * 60 + minute(ts) as minute from events)"


@query(f"select a.event_id as a_event_id, b.event_id as b_event_id from {_SLOTS} a join {_SLOTS} b on a.day = b.day and a.event_type = b.event_type and a.event_id < b.event_id and abs(a.minute - b.minute) <= 30 and a.user_id <> b.user_id")
def d04_slot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type on a day within half an hour, of different users."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    return joins.close_pairs(e, ["day", "event_type"], "event_id", "minute", 30, C("a_user_id") != C("b_user_id")).select("a_event_id", "b_event_id")


@query("""with p as (select distinct date, unnest(participants) as who, row_id from elmuletazo), q as (select distinct date, unnest(participants) as who, id from vadetoros)
  select p.row_id, q.id, count(*) as people from p join q on p.date = q.date and p.who = q.who group by all""")
def j02_people_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two feeds on the same day with the same people."""
    p = table(spark, sf_dir, "elmuletazo").select("row_id", "date", F.explode("participants").alias("who")).distinct()
    q = table(spark, sf_dir, "vadetoros").select("id", "date", F.explode("participants").alias("who")).distinct()
    return p.join(q, ["date", "who"]).groupBy("row_id", "id").agg(F.count("*").alias("people"))


@query(f"""select id, coalesce(nullif(time, ''), '99:99') as start, location from {_LATEST} where date = (select date from {_LATEST} group by 1 order by count(*) desc, 1 limit 1)""")
def o02_busiest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agenda of the day with most events, in order of time, then place."""
    v = _latest(spark, sf_dir, "date", "time", "location")
    day = v.groupBy("date").count().agg(F.max_by("date", F.struct("count", (-F.unix_date(F.to_date("date"))).alias("d"))).alias("date"))
    start = F.coalesce(F.nullif("time", F.lit("")), F.lit("99:99"))
    return v.join(day, "date").orderBy(start, F.collate(F.coalesce("location", F.lit("")), "es"), "id").select("id", start.alias("start"), "location")


# -- whole outputs ------------------------------------------------------------------------------------------------
_column("x01_block_texts", "documents", lambda: F.array_join(extract.blocks(C("text"), "Además", "(?i)de"), "¶"), """array_to_string(list_filter(list_transform(string_split("text", 'Además'), lambda z, i: case when i > 1 then 'Además' || z else z end), lambda z: regexp_matches(z, '(?i)de')), '¶')""", "doc_id")
_spoken_week = lambda: F.concat(F.lit("Del "), F.dayofmonth(F.to_date("date")).cast("string"), F.lit(" de "), F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(F.to_date("date")) - 1), F.lit(" al "), F.dayofmonth(F.date_add(F.to_date("date"), 6)).cast("string"), F.lit(" de "), F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(F.date_add(F.to_date("date"), 6)) - 1), F.lit(" de "), F.year(F.date_add(F.to_date("date"), 6)).cast("string"))
_column("f49_whole_week", "vadetoros", lambda: F.array_join(F.transform(dates.week_dates(_spoken_week()), dates.iso_day), " "), "array_to_string(list_transform(range(0, 7), lambda i: strftime(cast(date as date) + i::int, '%Y-%m-%d')), ' ')")
_column("s18_all_sundays", "lasventas", lambda: F.array_join(F.transform(dates.sundays(F.to_date("date"), 12), dates.iso_day), " "), "array_to_string(list_transform(range(0, 12), lambda i: strftime(cast(date as date) + cast((7 - dayofweek(cast(date as date))) % 7 as int) + (7 * i)::int, '%Y-%m-%d')), ' ')")
_column("f82_merged_names", "vadetoros", lambda: F.array_join(arrays.merged(F.slice(C("participants"), 1, 2), C("participants"), lambda a, b: similarity.share_of_larger(similarity.words(text.normalized(a)), similarity.words(text.normalized(b))) >= 0.75), "|"), "array_to_string(list_filter(participants, lambda z, i: i <= 2 or list_position(participants, z) = i), '|')")
_best = lambda: arrays.best_per_name(F.transform(C("participants"), lambda p, i: F.struct(F.substring(p, 1, 1).alias("name"), (F.length(p) % 7).alias("confidence"), i.alias("i"))))
_firsts = "list_transform(participants, lambda q: substring(q, 1, 1))"
_own = "list_filter(participants, lambda q: substring(q, 1, 1) = nm)"
_column("f84_best_details", "vadetoros", lambda: F.array_join(F.transform(_best(), lambda d: F.concat(d["name"], d["i"].cast("string"))), ","), f"array_to_string(list_transform(list_filter({_firsts}, lambda z, i: list_position({_firsts}, z) = i), lambda nm: nm || (list_filter(range(0, len(participants)), lambda k: substring(participants[k + 1], 1, 1) = nm and length(participants[k + 1]) % 7 = list_max(list_transform({_own}, lambda q: length(q) % 7)))[1])), ',')")
_html_bits = lambda: F.concat(F.lit("a&#xE9;&#233;&#XE9;&amp;lt; &#9999999;&#xD800; "), F.coalesce("title", F.lit("")), F.lit(" &ntilde;&Ntilde;&euro;"))
_column("f14_decoded", "documents", lambda: text.decoded_entities(_html_bits()), "'aééé&lt; \ufffd\ufffd ' || coalesce(title, '') || ' ñÑ€'", "doc_id")
_column("f15b_encoded", "vadetoros", lambda: F.url_encode(F.concat(F.regexp_replace(text.fold_accents(F.coalesce("location", F.lit(""))), "[^A-Za-z0-9]", " "), F.lit("/ñ&?"))), "regexp_replace(regexp_replace(strip_accents(coalesce(location, '')), '[^A-Za-z0-9]', ' ', 'g'), ' ', '+', 'g') || '%2F%C3%B1%26%3F'")


@query("select row_id, date, location, title from canalsur")
def s02_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed written as JSON envelopes, a file each by its kind of event, and read again as events; a missing source is an empty one."""
    place = f"{shared_folder(spark)}/envelopes-{uuid.uuid4().hex}"
    event = F.struct(C("row_id").cast("string").alias("id"), "date", "location", "title")
    t = table(spark, sf_dir, "canalsur")
    t.groupBy(F.coalesce("type", F.lit("")).alias("source")).agg(F.collect_list(event).alias("events")).withColumn("updatedAt", F.lit("2025-01-01")).coalesce(1).write.option("maxRecordsPerFile", 1).json(place)
    found = readers.events_of(readers.json_documents(spark, place, strict=True))
    none = readers.events_of(readers.optional(spark, f"{place}-none", readers.ENVELOPE).withColumn("file", F.lit("")))
    return readers.first_filled(none, found).select(C("id").cast("bigint").alias("row_id"), "date", "location", "title")


_SCHEDULE = lambda: F.concat(F.lit("Hoy 25:00 no. "), F.array_join(F.transform("participants", lambda p, i: F.concat((i + 9).cast("string"), F.lit(":30 "), p)), " "))


@query(f"select row_id, i as pos, lpad((i + 8)::varchar, 2, '0') || ':30' as time, {_squeezed('p')} as entry from (select row_id, unnest(participants) as p, generate_subscripts(participants, 1) as i from vadetoros) where {_squeezed('p')} <> ''")
def x08_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each day's schedule by the hours that stand in its text."""
    t = table(spark, sf_dir, "vadetoros").where(F.size("participants") > 0).select("row_id", _SCHEDULE().alias("text"))
    return extract.by_hours(t, "text").select("row_id", C("pos").cast("bigint").alias("pos"), "time", "entry")


_column("f81b_plain_names", "vadetoros", lambda: F.array_join(arrays.plain_names(F.transform("participants", lambda p, i: F.when(i == 0, F.concat(F.lit("Rejoneador: "), p, F.lit(" (debut)."))).when(i == 1, F.concat(F.lit("con picadores "), p)).otherwise(p)), "rejoneador|novillero", "(?i)picadores"), "|"), f"coalesce(array_to_string(list_filter(list_transform(list_filter(participants, lambda z, i: i <> 2), lambda z: {_squeezed("regexp_replace(z, '[" + chr(92) + "s.,;]+$', '')")}), lambda z: z <> ''), '|'), '')")
_column("p11_nearby_key", "vadetoros", lambda: labels.joined_key([C("date"), C("time"), text.first_filled(C("location"), C("name")), C("type")], normal=False), "coalesce(date, '') || '|' || coalesce(time, '') || '|' || coalesce(nullif(location, ''), nullif(name, ''), '') || '|' || coalesce(type, '')")
_MANY = {"channel": ["Canal Ribera"], "location": ["Madralba (Altozano Real)"], "type": ["Rejones"], "breeding": ["Marqués de Sabiteña"], "contentType": ["festejo"], "participants": ["Víctor Gallededor"]}
_HITS = ", ".join(f"case when {'list_contains(participants, ' + chr(39) + v + chr(39) + ')' if c == 'participants' else c + ' = ' + chr(39) + v + chr(39)} then '{c}: {v}' end" for c, vs in _MANY.items() for v in vs)
_column("j07_six_dimensions", "vadetoros", lambda: F.array_join(F.array_compact(F.array(*[F.when(F.array_contains(c, v) if c == "participants" else C(c) == v, f"{c}: {v}") for c, vs in _MANY.items() for v in vs])), "; "), f"array_to_string(list_filter([{_HITS}], lambda z: z is not null), '; ')")
_pair = ["victor gallededor", "pablo murcibochi"]
_alike = lambda x, y: f"({fuzzy_sql(x, y)}) >= 0.6"
_lower = _normal("z")
_column(
    "f53b_soft_share", "canalextremadura", lambda: F.round(similarity.soft_share(F.coalesce("participants", F.array().cast("array<string>")), F.array(*map(F.lit, ("Victor Gallededor", "Pablo Murcibochi"))), 0.6), 6),
    f"round(case when coalesce(len(participants), 0) = 0 then 0.0 when len(participants) <= 2 then len(list_filter(participants, lambda z: {' or '.join(_alike(_lower, chr(39) + y + chr(39)) for y in _pair)})) / len(participants)::double else ({' + '.join(f'case when len(list_filter(participants, lambda z: {_alike(_lower, chr(39) + y + chr(39))})) > 0 then 1 else 0 end' for y in _pair)}) / 2.0 end, 6)",
)
