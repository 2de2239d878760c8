"""Queries over places, labels and classes of events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagre.functions import labels, places
from almagre.plans.function_queries import _normal, _squeezed
from almagre.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def _column(name: str, source: str, expression: Callable[[], Column], sql: str, key: str = "row_id") -> None:
    """Registers ``(key, result)`` of an expression over a table; ``sql`` is the same expression."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).select(key, expression().alias("result"))
    SQL[name] = f"select {key}, {sql} as result from {source}"


def _cases(text: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{p}') then '{x}'" for p, x in rules) + f" else {otherwise} end"


def _contained(text: str, pairs, otherwise: str) -> str:
    return "case " + " ".join(f"when contains({text}, '{k}') then '{v}'" for k, v in pairs) + f" else {otherwise} end"


def _said(text: str, also=()) -> str:
    for p, by in (*places.UNSAID, *also):
        text = rf"regexp_replace({text}, '\b{p}\b', '{by}', 'g')"
    return _squeezed(text)


_bare = lambda x: rf"regexp_replace(coalesce({x}, ''), '\([^)]*\)', ' ', 'g')"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_name = lambda x: _squeezed(rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\s*\(\d{{2}}/\d{{2}}/\d{{4}}\)\s*$', ''), '(?i)^ganader[ií]a\s*:\s*', '')")


def canonical_sql(x: str) -> str:
    text = _said(_normal(_bare(x)))
    inner = _contained(text, [(t, t) for t in places.TOWNS] + list(places.PROVINCE_TOWNS), text)
    return f"case when contains({_normal(f'coalesce({x}, {chr(39) * 2})')}, 'las ventas') then 'madrid' else {inner} end"


def match_sql(x: str) -> str:
    plain = "|".join(c for c in places.COUNTRIES if c[-1].isascii())
    return _normal(rf"regexp_replace({_bare(x)}, '(?i)\b(?:{plain})\b', ' ', 'g')")


def fuzzy_sql(a: str, b: str) -> str:
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) > 1))"
    share = f"case when len({words(a)}) = 0 or len({words(b)}) = 0 then 0.0 else len(list_intersect({words(a)}, {words(b)}))::double / greatest(len({words(a)}), len({words(b)})) end"
    return f"case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0.0 when {a} = {b} then 1.0 else greatest({share}, 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) end"


generic_sql = lambda x: f"coalesce({_normal(x)}, '') in ('', {_list(places.GENERIC)})"
listing_sql = lambda xs: "(" + " or ".join(f"(coalesce({_normal(x)}, '') <> '' and ({_normal(x)} in ({_list(places.GENERIC)}) or regexp_matches({_normal(x)}, '{places.LISTING}')))" for x in xs) + ")"
channel_sql = lambda x: _cases(f"coalesce({_normal(x)}, '')", labels.CHANNELS, f"coalesce(nullif({_name(x)}, ''), 'Televisión')")
type_sql = lambda x: f"case when coalesce({_normal(x)}, '') = '' then 'Festejo taurino' else {_cases(f'coalesce({_normal(x)}, {chr(39) * 2})', labels.TYPES, _name(x))} end"
none_sql = lambda x, words: f"coalesce({_normal(x)}, '') in ('', {_list(words)})"
_QUOTES = "[«»“”\"''´`]"


def breeding_sql(x: str) -> str:
    """Without entities, which these tables don't hold."""
    text = rf"regexp_replace(coalesce({x}, ''), '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g')"
    text = _squeezed(rf"regexp_replace({text}, '{_QUOTES}', ' ', 'g')")
    text = _name(rf"regexp_replace({text}, '(?i)^(?:\s*ganader[íi]a\s*[:\-–—]?[\s:–—-]*)+', '')")
    return rf"case when length({text}) > 220 or regexp_matches({text}, '(?i)servicio gratis|me gusta responder|comentarios?|pulsa aqu[ií]') then '' else {text} end"


# -- places ---------------------------------------------------------------------------------------------
_column("f11_generic", "canalsur", lambda: places.generic_label(C("location")), generic_sql("location"))
_column("f11_listing", "canalextremadura", lambda: places.generic_listing([C("location"), C("title"), C("type")]), listing_sql(["location", "title", "type"]))
_ventas = lambda: F.when(C("row_id") % 7 == 0, F.concat(F.lit("Plaza de toros de Las Ventas, "), C("location"))).when(C("row_id") % 7 == 1, F.concat(F.lit("San Sebastián de los Reyes (Madrid) – "), C("location"))).otherwise(C("location"))
_ventas_sql = "case when row_id % 7 = 0 then 'Plaza de toros de Las Ventas, ' || location when row_id % 7 = 1 then 'San Sebastián de los Reyes (Madrid) – ' || location else location end"
_column("f12_canonical_place", "vadetoros", lambda: places.canonical_place(_ventas()), canonical_sql(f"({_ventas_sql})"))
_shown = _said(_normal(f"coalesce({_ventas_sql}, '')"), (("las ventas", " madrid "),))
_column("f12b_shown_place", "vadetoros", lambda: places.shown_place(_ventas()), _contained(_shown, [(t, t) for t in places.TOWNS], _shown))
_column("f12c_match_place", "elmuletazo", lambda: places.match_place(F.concat(C("location"), F.lit(" España, Francia y France"))), match_sql("(location || ' España, Francia y France')"))
_with_country = "(case when row_id % 3 = 0 then 'Plaza de toros de ' || location || ' España' when row_id % 3 = 1 then location || ', PERÚ' else location end)"
_town = rf"trim(regexp_extract({_squeezed(rf'regexp_replace(coalesce({_with_country}, {chr(39) * 2}), {chr(39)}(?i)\b(plaza de toros|plaza monumental|coso taurino)\b{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '^([^,(]+)', 1))"
_column("f12d_search_name", "vadetoros", lambda: places.search_name(F.expr(_with_country.replace("||", "||"))), rf"{_town} || case when coalesce(regexp_extract({_with_country}, '(?i)(España|Portugal|Francia|México|Colombia|Perú|Ecuador)', 1), '') <> '' then case when {_town} = '' then '' else ', ' end || regexp_extract({_with_country}, '(?i)(España|Portugal|Francia|México|Colombia|Perú|Ecuador)', 1) else '' end")
_led = lambda: F.concat(F.lit("Sábado, 15 de agosto de 2025 – 18:30 h: "), C("location"), F.lit(". Con toros de X"))
_column("f12e_cleaned_place", "lasventas", lambda: places.without_tail(places.without_lead(_led()), ["con toros", "desde las"]), rf"regexp_replace({_squeezed('location')}, '[\s,.;:–—-]+$', '')")
_column("f52_place_similarity", "vadetoros", lambda: F.round(places.place_similarity(C("location"), F.lit("Zarzuelón del Río (Tierra Parda)")), 6), f"round({fuzzy_sql(match_sql('location'), chr(39) + 'zarzuelon del rio' + chr(39))}, 6)")
_points = lambda v: f"(length({v}) + case when regexp_matches({v}, '(?i)plaza de toros') then 30 else 0 end + case when regexp_matches({v}, '(?i)monumental') then 20 else 0 end + case when contains({v}, '(') then 10 else 0 end - case when regexp_matches({v}, '(?i)españa') then 8 else 0 end)"
_a, _b = "trim(coalesce(location, ''))", "trim(coalesce(name, ''))"
_column("f57_more_telling", "lasventas", lambda: places.more_telling(C("location"), C("name")), f"case when {_a} = '' then {_b} when {_b} = '' then {_a} when {_points(_a)} >= {_points(_b)} then {_a} else {_b} end")
_text = _normal("concat_ws(' ', location, sourceText)")
_column("p06_country", "elmuletazo", lambda: places.country_code([C("location"), C("sourceText")]), _contained(_text, [(t, c) for c, ts in places.COUNTRY_TERMS for t in ts], "'ES'"))

# -- labels and classes -----------------------------------------------------------------------------------
_column("f05_cleaned_name", "onetoro", lambda: labels.cleaned_name(F.concat(F.lit("Ganadería: "), C("name"), F.lit(" (15/08/2025)"))), _name("('Ganadería: ' || name || ' (15/08/2025)')"))
_column("f06_breeding", "vadetoros", lambda: labels.cleaned_breeding(F.concat(F.lit("«Ganadería: ganaderia – "), C("breeding"))), breeding_sql("('«Ganadería: ganaderia – ' || breeding)"))
_column("f06b_shown_breeding", "lasventas", lambda: labels.cleaned_breeding(C("breeding")), breeding_sql("breeding"))
_column("f06c_without_edges", "vadetoros", lambda: labels.without_edges(F.concat(F.lit("«"), C("breeding"), F.lit("».."))), _squeezed(rf"regexp_replace(coalesce(breeding, ''), '^[\"''«»“”‘’]+|[\"''«»“”‘’.\s]+$', '', 'g')"))
_column("f07_channel_name", "elmuletazo", lambda: labels.channel_name(F.when(C("row_id") % 3 == 0, "Castilla-La Mancha TV").otherwise(C("channel"))), channel_sql("(case when row_id % 3 = 0 then 'Castilla-La Mancha TV' else channel end)"))
_column("f10_type_name", "elmuletazo", lambda: labels.type_name(C("type")), type_sql("type"))
_column("f08b_not_televised", "lasventas", lambda: labels.not_televised(C("televised"), C("channel")), f"coalesce(televised = false, false) or {none_sql('channel', labels.NOT_SHOWN)}")
_column("f09_deferred_flag", "elmuletazo", lambda: labels.deferred(F.lit(None).cast("boolean"), [F.when(C("row_id") % 5 == 0, F.lit("en DIFERIDO")), C("sourceText"), C("type"), C("channel")]), r"regexp_matches(concat_ws(' ', case when row_id % 5 = 0 then 'en DIFERIDO' end, sourceText, type, channel), '(?i)\b(?:en\s+)?diferido\b')")
_column("p05_type_class", "vadetoros", lambda: labels.type_class(C("type")), _cases(f"coalesce({_normal('type')}, '')", labels.CLASSES, "'other'"))
_raw = "trim(coalesce(nullif(channel, ''), nullif(sourceUrl, ''), ''))"
_confirmed = f"(not coalesce(televised = false, false) and (coalesce(televised, false) or coalesce({_normal(_raw)}, '') not in ('', {_list(labels.UNNAMED)})))"
_shown_label = f"case when {_confirmed} then coalesce(nullif({_raw}, ''), 'Emisión confirmada') else 'Sin emisión confirmada' end"
_column("p07_broadcast", "lasventas", lambda: labels.broadcast(C("channel"), C("sourceUrl"), C("televised"))["label"], _shown_label)
_LINKS = [("Canal Ribera", "https://ribera.example"), ("Tele Dehesa", "https://dehesa.example"), ("Canal", "https://canal.example")]
_column(
    "p08_broadcast_url", "lasventas", lambda: labels.broadcast_url([F.when(C("row_id") % 11 == 0, C("eventUrl"))], labels.broadcast(C("channel"), C("sourceUrl"), C("televised")), _LINKS),
    f"coalesce(nullif(case when row_id % 11 = 0 then trim(eventUrl) end, ''), case when {_confirmed} then case " + " ".join(f"when contains({_normal(_shown_label)}, lower('{n}')) then '{u}'" for n, u in _LINKS) + " else '' end end, '')",
)
_column("p10_programme_name", "canalextremadura", lambda: labels.programme_name([C("title"), C("type"), C("location")]), "trim(coalesce(" + ", ".join(f"case when coalesce({_normal(c)}, '') not in ('', 'television', 'programa taurino') then {c} end" for c in ("title", "type", "location")) + ", nullif(title, ''), nullif(type, ''), 'Programa taurino'))")
_column("p11_event_key", "vadetoros", lambda: labels.joined_key([C("date"), C("time"), C("type"), C("location")]), " || '|' || ".join(f"coalesce({_normal(c)}, '')" for c in ("date", "time", "type", "location")))
_column("p11b_event_label", "lasventas", lambda: labels.dotted_label([C("type"), C("location"), C("date"), C("time")]), "concat_ws(' · ', nullif(type, ''), nullif(location, ''), nullif(date, ''), nullif(time, ''))")
_mins = "row_id % 30 * 30"
_column("p11b_lead_time", "lasventas", lambda: labels.lead_time(F.expr(_mins)), f"case when {_mins} = 60 then '1 hora' when {_mins} > 60 and {_mins} % 60 = 0 then ({_mins} // 60) || ' horas' else ({_mins}) || ' min' end")
_column("p12_moved_sign", "documents", lambda: labels.moved_signal([C("title"), C("text")]), "regexp_matches(concat_ws(' ', title, \"text\"), '(?i)aplaz|cambi[ao]|reubic|nueva.?fecha|traslad')", "doc_id")
_said_sql = lambda c: f"(coalesce({c}, '') <> '' and not {generic_sql(c)})"
information_sql = f"(case when coalesce(time, '') <> '' then 4 else 0 end + case when {_said_sql('location')} then 8 else 0 end + case when {_said_sql('name')} then 8 else 0 end + case when {_said_sql('title')} then 5 else 0 end + case when coalesce(type, '') <> '' and {type_sql('type')} <> 'Festejo taurino' then 3 else 0 end + case when coalesce(breeding, '') <> '' then 4 else 0 end + case when coalesce(eventUrl, sourceUrl, '') <> '' then 1 else 0 end + least(8, coalesce(len(participants), 0) * 2))"
_column("f55_information", "lasventas", lambda: labels.information(C("time"), C("location"), C("name"), C("title"), C("type"), C("breeding"), C("participants"), F.coalesce("eventUrl", "sourceUrl")), information_sql)
_x, _y = "nullif(location, '')", "nullif(name, '')"
_column("f86_informative", "lasventas", lambda: labels.informative(F.when(C("row_id") % 4 == 0, "Televisión").otherwise(C("location")), C("name"), C("row_id") % 2 == 0), f"""case when nullif(case when row_id % 4 = 0 then 'Televisión' else location end, '') is null or {_y} is null then coalesce(nullif(case when row_id % 4 = 0 then 'Televisión' else location end, ''), {_y}, location, name)
  when row_id % 4 = 0 or {generic_sql('location')} then case when {generic_sql('name')} then case when row_id % 2 = 0 then name else case when row_id % 4 = 0 then 'Televisión' else location end end else name end when {generic_sql('name')} then location when row_id % 2 = 0 then name else location end""")
