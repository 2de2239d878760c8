"""Queries that run each column function over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagre.functions import arrays, dates, similarity, text
from almagre.operators import extract
from almagre.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _column(name: str, source: str, expression: Callable[[], Column], sql: str | None, key: str = "row_id") -> None:
    """Registers ``(key, result)`` of an expression over a table; ``sql`` is the same expression."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).select(key, expression().alias("result"))
    if sql is not None:
        SQL[name] = f"select {key}, {sql} as result from {source}"


def _date_column(name: str, source: str, expression: Callable[[], Column], sql: str) -> None:
    """The same for a date, compared as text."""
    _column(name, source, lambda: F.date_format(expression(), "yyyy-MM-dd"), f"strftime(cast({sql} as date), '%Y-%m-%d')")


_WS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_squeezed = lambda x: f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"
_normal = lambda x: rf"trim(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
C = F.col

# -- text ---------------------------------------------------------------------------------------------
_column("f01_normalized", "vadetoros", lambda: text.normalized(C("location")), _normal("location"))
_column("f02_folded", "elmuletazo", lambda: text.folded(C("channel")), "trim(lower(strip_accents(channel)))")
_column("f03_folded_squeezed", "canalextremadura", lambda: text.squeezed(text.folded(C("title"))), _squeezed("trim(lower(strip_accents(title)))"))
_column("f04_squeezed", "onetoro", lambda: text.squeezed(C("name")), _squeezed("name"))
_column("f04_without_invisible", "elmuletazo", lambda: text.without_invisible(C("location")), r"regexp_replace(location, '[\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g')")
_column("f05_without_trailing_date", "onetoro", lambda: text.without_trailing_date(C("name")), _squeezed(r"regexp_replace(name, '\s*\(\d{1,2}/\d{1,2}/\d{2,4}\)\s*$', '')"))
_HERDS = ["ganader[íi]a", "hijos de", "viuda de", "herederos de"]
_column(
    "f06_without_prefixes", "vadetoros", lambda: text.without_prefixes(C("breeding"), _HERDS),
    _squeezed(rf"regexp_replace(breeding, '(?i)^(?:\s*(?:{'|'.join(_HERDS)})\s*[:\-–—]?[\s:–—-]*)+', '')"),
)
_column("f06_accepted", "lasventas", lambda: text.accepted(C("breeding"), 60, r"(?i)leer más|\|"), r"case when breeding is null or length(breeding) > 60 or regexp_matches(breeding, '(?i)leer más|\|') then '' else breeding end")
_CHANNELS = [("(?i)ribera", "Canal Ribera"), ("(?i)vega ?alta", "Canal Vega Alta"), ("(?i)dehesa", "Tele Dehesa"), ("(?i)canal", "another channel")]
_TYPES = [("(?i)mixt", "mixta"), ("(?i)rejon", "rejones"), (r"(?i)sin (pic|cab)|s/p", "sin picadores"), ("(?i)novillada", "novillada"), ("(?i)corrida", "corrida")]
_case = lambda col, rules, other: "case " + " ".join(f"when regexp_matches({col}, '{p}') then '{x}'" for p, x in rules) + f" else {other} end"
_column("f07_channel_ladder", "elmuletazo", lambda: text.ladder(C("channel"), _CHANNELS, C("channel")), _case("channel", _CHANNELS, "channel"))
_column("f10_type_ladder", "elmuletazo", lambda: text.ladder(C("type"), _TYPES, C("type")), _case("type", _TYPES, "type"))
_column("f08_without_tv", "lasventas", lambda: F.coalesce(C("channel"), F.lit("")).isin("", "Sin TV", "Por confirmar"), "coalesce(channel, '') in ('', 'Sin TV', 'Por confirmar')")
_column("f09_deferred", "elmuletazo", lambda: F.concat_ws(" ", "channel", "type", "sourceText").rlike(r"(?i)diferido|streaming"), "regexp_matches(concat_ws(' ', channel, type, sourceText), '(?i)diferido|streaming')")
_column(
    "f11_generic_label", "canalsur", lambda: F.coalesce(text.normalized(C("location")), F.lit("")).isin("", "television", "localidad por confirmar"),
    f"coalesce({_normal('location')}, '') in ('', 'television', 'localidad por confirmar')",
)
_column("f12_town", "vadetoros", lambda: F.regexp_extract("location", r"^([^,(]+)", 1), "regexp_extract(location, '^([^,(]+)', 1)")
_html = lambda: F.concat(
    F.lit("<div><h1>"), text.html_escaped(F.coalesce("title", F.lit(""))), F.lit("</h1><script>var a = 1 < 2;</script><!-- <b>no</b> --><style>p {}</style><p>"),
    text.html_escaped(F.coalesce("text", F.lit(""))), F.lit("</p>&nbsp;&#233;&amp;lt;</div>"),
)
_column("f13_html_text", "documents", lambda: text.html_text(_html()), _squeezed("coalesce(title, '') || '   ' || coalesce(\"text\", '') || '  é&lt; '"), "doc_id")
_column("f15_html_escaped", "documents", lambda: text.html_escaped(C("text")), "replace(replace(replace(replace(replace(\"text\", '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')", "doc_id")
_column("f14_entities", "documents", lambda: text.decoded_entities(text.html_escaped(C("text"))), '"text"', "doc_id")
_column("f13b_cut_from", "documents", lambda: text.cut_from(C("text"), ["además", "also,"]), "regexp_replace(regexp_replace(\"text\", '(?is)(?:además).*$', ''), '(?is)(?:also,).*$', '')", "doc_id")
_meta = lambda: F.when(C("row_id") % 2 == 0, F.concat(F.lit('<meta property="og:title" content="'), "name", F.lit('">'))).otherwise(
    F.concat(F.lit("<meta content='"), F.replace(C("name"), F.lit("'"), F.lit("")), F.lit("' name='og:title'/>"))
)
_column("f15c_meta_content", "onetoro", lambda: text.meta_content(_meta(), "og:title"), "nullif(name, '')")
_column("f15b_url_decoded", "vadetoros", lambda: F.url_decode(F.url_encode(C("location"))), "location")
_column("f61_slug", "vadetoros", lambda: text.clipped_slug(C("location"), 24), "substring(regexp_replace(regexp_replace(lower(strip_accents(location)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24)")
_column("p09_initials", "vadetoros", lambda: text.initials(C("channel"), 3), f"upper(array_to_string(list_transform(list_filter(string_split({_squeezed('channel')}, ' '), lambda x: x <> '')[1:3], lambda x: substring(x, 1, 1)), ''))")
_column("p09_length_class", "onetoro", lambda: text.length_class(C("name"), [(42, "long"), (28, "middle")], "short"), "case when length(name) >= 42 then 'long' when length(name) >= 28 then 'middle' else 'short' end")
_column("x11_any_and_any", "documents", lambda: text.any_and_any(F.lower("text"), ["canal", "emisión"], ["toro", "feria"]), "(contains(lower(\"text\"), 'canal') or contains(lower(\"text\"), 'emisión')) and (contains(lower(\"text\"), 'toro') or contains(lower(\"text\"), 'feria'))", "doc_id")
_column("x12_keyword", "canalextremadura", lambda: C("title").rlike("(?i)toros|encastes|ruedo"), "regexp_matches(title, '(?i)toros|encastes|ruedo')")
_column("p12_moved_signal", "documents", lambda: C("text").rlike("(?i)aplaza|suspend|traslad"), "regexp_matches(\"text\", '(?i)aplaza|suspend|traslad')", "doc_id")
_a = lambda: F.concat(F.lit('<a href="'), "eventUrl", F.lit('">a</a><a href="'), "sourceUrl", F.lit('">b</a><a class=x href=\''), "eventUrl", F.lit("'>c</a>"))
_column("s09_links", "vadetoros", lambda: F.array_join(text.links(_a(), "festejo", 40), " "), "case when contains(eventUrl, 'festejo') then eventUrl || case when contains(sourceUrl, 'festejo') and sourceUrl <> eventUrl then ' ' || sourceUrl else '' end when contains(sourceUrl, 'festejo') then sourceUrl else '' end")
_xml = lambda: F.concat(F.lit("<rss><item><title><![CDATA[ "), F.coalesce("title", F.lit("")), F.lit("]]></title><link>"), "sourceUrl", F.lit("</link></item></rss>"))
_column("s15_xml_items", "canalsur", lambda: F.concat_ws("|", F.get(text.xml_items(_xml(), "item", ["title", "link"]), F.lit(0))["title"], "sourceUrl"), f"{_squeezed(chr(39) + ' ' + chr(39) + ' || coalesce(title, ' + chr(39) * 2 + ')')} || '|' || sourceUrl")

# -- dates and times ----------------------------------------------------------------------------------
_spoken = lambda: F.concat(F.dayofmonth(F.to_date("date")).cast("string"), F.lit(" de "), F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(F.to_date("date")) - 1), F.lit(" de "), F.substring("date", 1, 4))
_date_column("f30_spanish_date", "vadetoros", lambda: dates.spanish_date(F.concat(F.lit("será el "), _spoken(), F.lit(" a las 5"))), "cast(date as date)")
_date_column("f31_numeric_date", "elmuletazo", lambda: dates.numeric_date(C("sourceText")), r"try_strptime(nullif(regexp_extract(sourceText, '\d{1,2}/\d{1,2}/\d{4}'), ''), '%d/%m/%Y')::date")
_date_column("f32_calendar", "vadetoros", lambda: dates.numeric_date(F.concat((C("row_id") % 4 + 28).cast("string"), F.lit("/02/"), (C("row_id") % 9 + 2015).cast("string"))), "try_cast((row_id % 9 + 2015) || '-02-' || (row_id % 4 + 28) as date)")
_date_column("f33_in_year", "vadetoros", lambda: dates.in_year(F.concat_ws("/", F.dayofmonth(F.to_date("date")), F.month(F.to_date("date"))), F.lit("2025-10-15").cast("date")), "try_cast((2025 + case when month(cast(date as date)) < 4 then 1 else 0 end) || '-' || lpad(month(cast(date as date))::varchar, 2, '0') || '-' || lpad(day(cast(date as date))::varchar, 2, '0') as date)")
_column("f34_all_dates", "onetoro", lambda: F.array_join(F.transform(dates.all_numeric_dates(C("name")), lambda d: F.date_format(d, "yyyy-MM-dd")), ","), r"array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(name, '\d{1,2}/\d{1,2}/\d{4}'), lambda x: try_strptime(x, '%d/%m/%Y')), lambda x: x is not null), lambda x: strftime(x, '%Y-%m-%d')), ',')")
_column("f35_window", "vadetoros", lambda: dates.within(F.to_date("date"), F.lit("2025-06-01").cast("date"), 7, 180), "cast(date as date) between date '2025-05-25' and date '2025-11-28'")
_column("f36_hhmm", "vadetoros", lambda: dates.hhmm(C("time")), r"case when regexp_matches(time, '(?:^|[^\d:.])(?:[01]?\d|2[0-3])[:.h][0-5]\d(?:\D|$)') then lpad(regexp_extract(time, '(?:^|[^\d:.])([01]?\d|2[0-3])[:.h]([0-5]\d)', 1), 2, '0') || ':' || regexp_extract(time, '(?:^|[^\d:.])([01]?\d|2[0-3])[:.h]([0-5]\d)', 2) end")
_MIN = r"case when regexp_matches(time, '^\d{1,2}:\d{2}$') then cast(split_part(time, ':', 1) as int) * 60 + cast(split_part(time, ':', 2) as int) end"
_column("f37_minutes", "vadetoros", lambda: dates.minutes(C("time")), _MIN)
_column("f38_closeness", "vadetoros", lambda: dates.closeness(dates.minutes(C("time")), F.lit(1110), [(0, 1.0), (30, 0.8), (60, 0.5), (90, 0.25)]), f"case when ({_MIN}) is null then 0.0 when ({_MIN}) = 1110 then 1.0 when abs(({_MIN}) - 1110) <= 30 then 0.8 when abs(({_MIN}) - 1110) <= 60 then 0.5 when abs(({_MIN}) - 1110) <= 90 then 0.25 else 0.0 end::double")
_column("f39_day_distance", "vadetoros", lambda: dates.day_distance(F.to_date("date"), F.to_date("fetchedAt")), "abs(datediff('day', cast(date as date), cast(fetchedAt as date)))")
_START = lambda: dates.to_utc(C("date"), C("time"))
_UTC = r"case when regexp_matches(time, '^\d{1,2}:\d{2}$') then (strptime(date || ' ' || lpad(time, 5, '0'), '%Y-%m-%d %H:%M') at time zone 'Europe/Madrid') at time zone 'UTC' end"
_column("f41_to_utc", "vadetoros", lambda: F.date_format(_START(), "yyyy-MM-dd HH:mm"), f"strftime({_UTC}, '%Y-%m-%d %H:%M')")
_THERE = f"((({_UTC}) at time zone 'UTC') at time zone 'Asia/Tokyo')"
_column(
    "f42_shifted_time", "vadetoros", lambda: dates.shifted_time(_START(), "Europe/Madrid", "Asia/Tokyo"),
    f"strftime({_THERE}, '%H:%M') || case when datediff('day', cast(date as date), {_THERE}::date) > 0 then ' +' || datediff('day', cast(date as date), {_THERE}::date) else '' end",
)
_LEN = lambda: F.when(C("contentType") == "programa", 60).when(C("type").rlike("(?i)recort"), 120).when(C("type").rlike("(?i)clase"), 90).otherwise(150)
_LEN_SQL = "case when contentType = 'programa' then 60 when regexp_matches(type, '(?i)recort') then 120 when regexp_matches(type, '(?i)clase') then 90 else 150 end"
_column("f43_duration", "vadetoros", lambda: _LEN(), _LEN_SQL)
_NOW = lambda: F.lit("2025-08-15 16:20:00").cast("timestamp_ntz")
_U = f"({_UTC})"
_column(
    "f44_status", "vadetoros", lambda: dates.span_status(_START(), _LEN(), _NOW()),
    f"""case when {_U} is null then 'unknown' when timestamp '2025-08-15 16:20:00' >= {_U} and timestamp '2025-08-15 16:20:00' < {_U} + to_minutes({_LEN_SQL}) then 'live'
    when timestamp '2025-08-15 16:20:00' >= {_U} + to_minutes({_LEN_SQL}) then 'finished' when epoch({_U}) - epoch(timestamp '2025-08-15 16:20:00') <= 900 then 'soon'
    when {_U}::date = date '2025-08-15' then 'today' when {_U}::date = date '2025-08-16' then 'tomorrow' else 'future' end""",
)
_column("f45_remaining", "vadetoros", lambda: dates.remaining(C("row_id") % 5000), "concat_ws(' ', case when row_id % 5000 // 1440 > 0 then (row_id % 5000 // 1440) || ' d' end, case when row_id % 5000 % 1440 // 60 > 0 then (row_id % 5000 % 1440 // 60) || ' h' end, case when row_id % 5000 % 60 > 0 then (row_id % 5000 % 60) || ' min' end)")
_column("f46_relative_day", "vadetoros", lambda: dates.relative_day(F.to_date("date"), F.lit("2025-08-15").cast("date")), "case date when '2025-08-14' then 'ayer' when '2025-08-15' then 'hoy' when '2025-08-16' then 'mañana' end")
_column("f47_eve", "vadetoros", lambda: F.date_format(dates.eve_at(F.to_date("date"), 20), "yyyy-MM-dd HH:mm"), "strftime(cast(date as date) - 1, '%Y-%m-%d') || ' 20:00'")
_column("f48_before", "events", lambda: F.date_format(dates.before(C("ts"), (C("event_id") % 2000).cast("int")), "yyyy-MM-dd HH:mm:ss"), "strftime(ts - to_minutes(case when event_id % 2000 between 5 and 1440 then event_id % 2000 else 30 end), '%Y-%m-%d %H:%M:%S')", "event_id")
_week = lambda: F.concat(F.lit("Del "), F.dayofmonth(F.to_date("date")).cast("string"), F.lit(" de "), F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(F.to_date("date")) - 1), F.lit(" al "), F.dayofmonth(F.date_add(F.to_date("date"), 6)).cast("string"), F.lit(" de "), F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(F.date_add(F.to_date("date"), 6)) - 1), F.lit(" de "), F.year(F.date_add(F.to_date("date"), 6)).cast("string"))
_date_column("f49_week_dates", "vadetoros", lambda: F.get(dates.week_dates(_week()), F.lit(0)), "cast(date as date)")
_date_column("s18_sundays", "lasventas", lambda: F.get(dates.sundays(F.to_date("date"), 12), F.lit(11)), "cast(date as date) + cast((7 - dayofweek(cast(date as date))) % 7 as int) + 77")

# -- similarity, scores, identifiers ------------------------------------------------------------------
_A, _B = _normal("location"), "'zarzuelon del rio tierra parda'"
_wordset = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) > 1))"
_share = lambda x, y, f: f"case when len({x}) = 0 or len({y}) = 0 then 0.0 else len(list_intersect({x}, {y}))::double / {f}(len({x}), len({y})) end"
_TOKENS = _share(_wordset(_A), _wordset(_B), "greatest")
_other = lambda: F.lit("zarzuelon del rio tierra parda")
_column("f19_shared_words", "vadetoros", lambda: F.round(similarity.share_of_larger(similarity.words(text.normalized(C("location"))), similarity.words(_other())), 6), f"round({_TOKENS}, 6)")
_column("f51_fuzzy", "vadetoros", lambda: F.round(similarity.fuzzy(text.normalized(C("location")), _other()), 6), f"round(case when {_A} is null or {_A} = '' then 0.0 when {_A} = {_B} then 1.0 else greatest({_TOKENS}, 1 - levenshtein({_A}, {_B})::double / greatest(length({_A}), length({_B}))) end, 6)")
_column("f54_contained", "vadetoros", lambda: F.round(similarity.contained(text.normalized(C("location")), F.lit("tierra parda"), 0.92), 6), f"round(case when {_A} is null or {_A} = '' then 0.0 when {_A} = 'tierra parda' then 1.0 when contains({_A}, 'tierra parda') or contains('tierra parda', {_A}) then 0.92 else {_share(_wordset(_A), '[' + chr(39) + 'tierra' + chr(39) + ',' + chr(39) + 'parda' + chr(39) + ']', 'greatest')} end, 6)")
_PEOPLE = "['Víctor Gallededor', 'Quintín Delgacol', 'Pablo Murciboche']"
_column("f53_overlap", "vadetoros", lambda: F.round(similarity.share_of_smaller(C("participants"), F.array(*map(F.lit, ("Víctor Gallededor", "Quintín Delgacol", "Pablo Murciboche")))), 6), f"round({_share('participants', _PEOPLE, 'least')}, 6)")
_column("f53b_soft_overlap", "canalextremadura", lambda: F.round(similarity.soft_share(C("participants"), F.array(F.lit("Victor Gallededor"), F.lit("Pablo Murcibochi")), 0.6), 6), None)
_column(
    "f55_filled_score", "vadetoros", lambda: similarity.filled_score({"time": 4, "location": 8, "name": 8, "title": 5, "breeding": 4}, {"participants": (2, 8)}),
    "case when coalesce(time, '') <> '' then 4 else 0 end + case when coalesce(location, '') <> '' then 8 else 0 end + case when coalesce(name, '') <> '' then 8 else 0 end + case when coalesce(title, '') <> '' then 5 else 0 end + case when coalesce(breeding, '') <> '' then 4 else 0 end + least(8, coalesce(len(participants), 0) * 2)",
)
_column("f16_confidence", "canalsur", lambda: similarity.confidence(F.array("source", F.lit("agenda"), F.coalesce("channel", F.lit("?"))), {"agenda": 90, "Onda Marisma": 96}, 80, 2, 100), "least(100, greatest(90, case when source = 'Onda Marisma' then 96 when source = 'agenda' then 90 else 80 end, case when coalesce(channel, '?') = 'Onda Marisma' then 96 when channel = 'agenda' then 90 else 80 end) + 4)")
_column("f60_sha_id", "vadetoros", lambda: similarity.sha_id("va", C("date"), C("location"), C("title")), "'va-' || substring(sha1(concat_ws('|', coalesce(date, ''), coalesce(location, ''), coalesce(title, ''))), 1, 14)")
_column("f61_slug_id", "canalsur", lambda: similarity.slug_id("cs", C("date"), C("title")), "substring(regexp_replace(regexp_replace(lower(strip_accents(concat_ws('-', 'cs', date, title))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70)")
_column("f66_rolling_hash", "part", lambda: similarity.rolling_hash(C("p_name")), "list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)", "p_partkey")
_column("f71_upper_median", "embeddings", lambda: F.round(similarity.upper_median(C("embedding")), 6), "round(list_sort(embedding)[len(embedding) // 2 + 1], 6)", "vec_id")
_column("a12_at_share", "embeddings", lambda: F.round(similarity.at_share(C("embedding"), 0.92), 6), "round(list_sort(embedding)[cast(floor(len(embedding) * 0.92) as int) + 1], 6)", "vec_id")
_column("f71_nearest", "embeddings", lambda: similarity.nearest(C("embedding"), F.lit(0.1)), "list_position(list_transform(embedding, lambda x: abs(x::double - 0.1)), list_min(list_transform(embedding, lambda x: abs(x::double - 0.1)))) - 1", "vec_id")

_in_order = lambda xs, part="": f"array_to_string(list_filter({xs}, lambda z, i: list_position({xs}, z) = i){part}, '|')"
_CLEAN = f"list_filter(list_transform(list_filter(coalesce(participants, []), lambda z: z is not null), lambda z: {_squeezed('z')}), lambda z: z <> '' and length(z) <= 40 and not regexp_matches(z, '(?i)leer|ver |entradas'))"
_NAMES = rf"list_filter(list_transform(string_split_regex(regexp_extract(sourceText, ' para (.*)\.$', 1), '\s*[,;·]\s*|\s+[ye]\s+'), lambda z: {_squeezed('z')}), lambda z: z <> '')"

# -- lists --------------------------------------------------------------------------------------------
_column("f80_cleaned", "lasventas", lambda: F.array_join(arrays.cleaned(C("participants"), 40, "(?i)leer|ver |entradas"), "|"), _in_order(_CLEAN))
_column("f81_split_names", "elmuletazo", lambda: F.array_join(arrays.split_names(F.regexp_extract("sourceText", r" para (.*)\.$", 1), 8), "|"), _in_order(_NAMES, "[1:8]"))
_column("f82_merged", "elmuletazo", lambda: F.size(arrays.merged(F.slice(F.coalesce("participants", F.array().cast("array<string>")), 1, 2), F.coalesce("participants", F.array().cast("array<string>")), lambda a, b: similarity.fuzzy(text.normalized(a), text.normalized(b)) >= 0.75)), None)
_column("f83_union", "vadetoros", lambda: F.array_join(F.array_union("participants", F.array(F.lit("Víctor Gallededor"))), "|"), "array_to_string(case when list_contains(participants, 'Víctor Gallededor') then participants else list_append(participants, 'Víctor Gallededor') end, '|')")
_column("f86_chosen", "lasventas", lambda: arrays.chosen(C("breeding"), C("name"), F.length("name") > F.length("breeding")), "case when length(name) > length(breeding) then coalesce(nullif(name, ''), nullif(breeding, '')) else coalesce(nullif(breeding, ''), nullif(name, '')) end")
_column("f88_joined", "canalextremadura", lambda: F.array_join("participants", " · "), "array_to_string(participants, ' · ')")
_column("f89_toggled", "vadetoros", lambda: F.array_join(arrays.toggled(C("participants"), F.lit("Víctor Gallededor")), "|"), "array_to_string(case when list_contains(participants, 'Víctor Gallededor') then list_filter(participants, lambda x: x <> 'Víctor Gallededor') else list_append(participants, 'Víctor Gallededor') end, '|')")
_details = lambda: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence"), C("row_id").alias("r")) for n, c in (("a", 80), ("b", 90), ("a", 95), ("b", 90))])
_column("f84_best_per_name", "lasventas", lambda: F.array_join(F.transform(arrays.best_per_name(_details()), lambda d: F.concat(d["name"], d["confidence"].cast("string"))), ","), "'a95,b90'")

# -- records out of text ------------------------------------------------------------------------------
_column("x01_blocks", "documents", lambda: F.size(extract.blocks(C("text"), r"Además", "(?i)de")), """len(string_split("text", 'Además')) - 1 + case when regexp_matches(string_split("text", 'Además')[1], '(?i)de') then 1 else 0 end""", "doc_id")
_column("x02_repeated", "documents", lambda: F.array_join(F.transform(extract.repeated(C("text"), r"(\d+) (euros|minutos|días)", {"n": 1, "unit": 2}), lambda m: F.concat_ws(" ", m["n"], m["unit"])), "|"), r"""array_to_string(regexp_extract_all("text", '\d+ (?:euros|minutos|días)'), '|')""", "doc_id")
_column("x05_lineup", "elmuletazo", lambda: F.concat_ws("|", extract.lineup(C("sourceText"), [r"con reses de (.*?) para "], [r" para (.*)\.$"])["breeding"]), f"coalesce(nullif({_squeezed(chr(39).join(['regexp_extract(sourceText, ', 'con reses de (.*?) para ', ', 1)']))}, ''), '')")
_column("x07_between", "elmuletazo", lambda: extract.between(C("sourceText"), "📺", "🏟"), f"nullif({_squeezed(chr(39).join(['regexp_extract(sourceText, ', '(?s)📺(.*?)(?:🏟|$)', ', 1)']))}, '')")
_column("x06_place", "elmuletazo", lambda: text.first_filled(extract.between(C("sourceText"), "🏟", r"\. 🐂"), C("location")), rf"coalesce(nullif({_squeezed(chr(39).join(['regexp_extract(sourceText, ', r'(?s)🏟(.*?)(?:\. 🐂|$)', ', 1)']))}, ''), nullif(location, ''))")


def x08_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document that begin at a capitalised connective."""
    return extract.fragments(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "Además, ").groupBy("doc_id").agg(F.count("*").alias("pieces"))


def f34_best_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each listing that stands nearest to telling words."""
    return extract.best_dated(table(spark, sf_dir, "elmuletazo").where("sourceText is not null"), "sourceText", "row_id", [("📺", 4), ("corrida", 3)], 60).select("row_id", "candidate", "score")


QUERIES |= {"x08_fragments": x08_fragments, "f34_best_dated": f34_best_dated}
SQL |= {
    "x08_fragments": """select doc_id, count(*) as pieces from (select doc_id, unnest(string_split("text", 'Además, ')) as p, generate_subscripts(string_split("text", 'Además, '), 1) as i
      from documents where "text" is not null) where i > 1 or trim(p) <> '' group by doc_id""",
}
