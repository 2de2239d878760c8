"""Queries of the merge: adapters, scores, the ordered fold, history, quarantine, exclusions, moved events; with their SQL where SQL has it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagre.functions import labels, places
from almagre.operators import display, merge, quality
from almagre.plans.function_queries import _normal
from almagre.plans.label_queries import breeding_sql, canonical_sql, channel_sql, fuzzy_sql, generic_sql, listing_sql, match_sql, none_sql, type_sql, _name
from almagre.session import cut, table

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


# The feeds in the order they are merged in, with their names as sources.
FEEDS = (("elmuletazo", "El Muletazo"), ("onetoro", "OneToro"), ("canalsur", "Canal Sur"), ("canalextremadura", "Canal Extremadura"), ("lasventas", "Las Ventas oficial"))


def _records(spark: SparkSession, sf_dir: str, feed: str, source: str, rank: int) -> DataFrame:
    """A feed's rows by the adapter of its kind."""
    df = table(spark, sf_dir, feed).withColumns({"rec": F.concat(F.lit(f"{feed}:"), C("row_id").cast("string")), "rank": F.lit(rank), "seq": C("row_id")})
    forced = {}
    if feed == "onetoro":  # a channel of its own; the place stands in the name
        forced = {"channel": F.lit("OneToro"), "location": labels.cleaned_name(C("name")), "contentType": F.lit("festejo")}
    elif feed in ("canalsur", "canalextremadura"):
        forced = {"source": F.lit(source)}
    return merge.adapted(df, source, forced, fetched="updatedAt" if "updatedAt" in df.columns else "fetchedAt")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_records(spark, sf_dir, feed, source, i) for i, (feed, source) in enumerate(FEEDS)])


_COLS = ["rec", "date", "time", "channel", "type", "contentType", "location", "breeding", "name", "title", "televised", "confidence", "status"]


def _adapted_sql(feed: str, source: str, channel: str = "channel", location: str = "location", title: str = "title") -> str:
    """The adapter of a feed in SQL."""
    name = "name" if feed in ("lasventas", "onetoro") else "null::varchar"
    programme = f"({'coalesce(contentType = ' + chr(39) + 'programa' + chr(39) + ', false) or ' if feed == 'lasventas' else ''}{type_sql('type')} = 'Programa taurino')"
    ch, loc = f"coalesce(nullif({channel}, ''), '{source}')", _name(f"coalesce(nullif({location}, ''), nullif({name}, ''), 'Televisión')")
    people = rf"list_distinct(list_filter(list_transform(list_filter(coalesce(participants, []), lambda z: z is not null), lambda z: {_name('z')}), lambda z: z <> '' and length(z) <= 90 and not regexp_matches(z, '(?i)\b(?:con|sin)\s+picadores\b|cookies?|privacidad|derechos reservados|publicidad|navegaci[oó]n')))"
    televised = "coalesce(televised, true) and " if feed == "lasventas" else ""
    breeding = "''" if feed == "onetoro" else f"case when {programme} then '' else {breeding_sql('breeding')} end"
    inner = f"""select '{feed}:' || row_id as rec, row_id as seq, nullif(date, '') as date, nullif(time, '') as time, {channel_sql(ch)} as channel, case when {programme} then 'Programa taurino' else {type_sql('type')} end as type,
      case when {programme} then 'programa' else 'festejo' end as contentType, {loc} as location, {breeding} as breeding, {_name(f"coalesce(nullif({name}, ''), nullif({title}, ''), nullif({location}, ''), nullif(type, ''), 'Festejo taurino')")} as name,
      case when coalesce({title}, '') <> '' then {_name(title)} end as title, {televised}not {none_sql(ch, labels.NO_CHANNEL)} as televised, case when {programme} then [] else {people} end as participants from {feed}"""
    trust = merge.RULES.trusted.get(source, merge.RULES.default_trust)
    return f"select *, least(100, {trust} + case when date <> '' and location <> '' and channel <> '' then 1 else 0 end + case when time <> '' then 1 else 0 end + case when breeding <> '' then 1 else 0 end + case when len(participants) > 0 then 1 else 0 end) as confidence from ({inner})"


_LV, _EL, _CE = _adapted_sql("lasventas", "Las Ventas oficial"), _adapted_sql("elmuletazo", "El Muletazo", title="null::varchar"), _adapted_sql("canalextremadura", "Canal Extremadura")
_CS = _adapted_sql("canalsur", "Canal Sur")
_OUT = ", ".join(c for c in _COLS if c != "status") + ", case when confidence >= 94 then 'confirmed' else 'probable' end as status"


@query(f"select {_OUT} from ({_LV}) union all select {_OUT} from ({_EL}) union all select {_OUT} from ({_CE}) union all select {_OUT} from ({_CS})")
def e01_adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four feeds' rows in one form."""
    return reduce(DataFrame.unionByName, [_records(spark, sf_dir, feed, source, i) for i, (feed, source) in enumerate(FEEDS) if feed != "onetoro"]).select(*_COLS)


def _score_sql() -> str:
    """The score of records a and b, over columns worked out once a side."""
    same = "(people >= .5 or herd >= .72)"
    return f"""case when a_date <> b_date or a_ct <> b_ct then 0.0 when a_place <> '' and b_place <> '' and not a_gl and not b_gl and a_place <> b_place and alike < .45 then 0.0
      when a_ct = 'festejo' and a_place <> '' and a_place = b_place and people >= .5 then 98.0 when a_ct = 'festejo' and a_place <> '' and a_place = b_place and herd >= .72 then 94.0
      when a_ct = 'festejo' and a_ch = b_ch and a_t = b_t and a_t <> '' and (a_gen or b_gen) and {same} then 96.0 when a_ct = 'festejo' and a_ch = b_ch and near >= .8 and a_list <> b_list then 97.0
      when a_ct = 'festejo' and a_ch = b_ch and near >= .8 and ((a_gen and b_det) or (b_gen and a_det)) and ({same} or alike >= .72) then 94.0
      when a_ct = 'festejo' and a_ch = b_ch and (a_t = '') <> (b_t = '') and alike >= .72 then 88.0
      else floor((40 + 35 * alike + case when a_place <> '' and a_place = b_place then 18 else 0 end + case when a_ch = b_ch then 8 else 0 end + 7 * near + 12 * people + 5 * herd) * 100 + .5) / 100 end"""


def _side_sql(records: str) -> str:
    label = "coalesce(nullif(location, ''), nullif(name, ''))"
    minute = r"case when regexp_matches(time, '^\d{1,2}:\d{2}$') then cast(split_part(time, ':', 1) as int) * 60 + cast(split_part(time, ':', 2) as int) end"
    return f"""select rec, date, contentType as ct, {channel_sql('channel')} as ch, {canonical_sql(label)} as place, {match_sql(label)} as m, {generic_sql(label)} as gl, coalesce(time, '') as t, {minute} as mins,
      ({generic_sql('location')} or {generic_sql('name')} or {generic_sql('title')}) as gen, {listing_sql(['location', 'name', 'title'])} as list, (not {generic_sql('location')} or len(participants) > 0 or breeding <> '') as det,
      {_normal('breeding')} as herd, list_distinct(list_filter(list_transform(participants, lambda z: {_normal('z')}), lambda z: z <> '')) as who from ({records})"""


_PAIR_COLS = ("rec", "date", "ct", "ch", "place", "m", "gl", "t", "mins", "gen", "list", "det", "herd", "who")


@query(f"""with s as materialized ({_side_sql(_LV)}), u as materialized ({_side_sql(_EL)}),
  p as (select {', '.join(f's.{c} as a_{c}' for c in _PAIR_COLS)}, {', '.join(f'u.{c} as b_{c}' for c in _PAIR_COLS)} from s join u on s.date = u.date and s.ct = u.ct),
  q as (select *, {fuzzy_sql('a_m', 'b_m')} as alike, {fuzzy_sql('a_herd', 'b_herd')} as herd, case when len(a_who) = 0 or len(b_who) = 0 then 0.0 else len(list_intersect(a_who, b_who))::double / least(len(a_who), len(b_who)) end as people,
    case when a_mins is null or b_mins is null then 0.0 when a_mins = b_mins then 1.0 when abs(a_mins - b_mins) <= 30 then .8 when abs(a_mins - b_mins) <= 60 then .5 when abs(a_mins - b_mins) <= 90 then .25 else 0.0 end as near from p)
  select a_rec, b_rec, score from (select a_rec, b_rec, {_score_sql()} as score from q) where score > 0""")
def e02_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all pairs of two feeds' records of a date and content type that don't exclude each other."""
    a, b = (_records(spark, sf_dir, feed, source, 0) for feed, source in (("lasventas", "Las Ventas oficial"), ("elmuletazo", "El Muletazo")))
    left, right = (df.select(*[C(c).alias(f"{s}{c}") for c in df.columns]) for df, s in ((merge.score_keys(a), "a_"), (merge.score_keys(b), "b_")))
    pairs = left.join(right, (C("a_date") == C("b_date")) & (C("a_contentType") == C("b_contentType")))
    return pairs.select("a_rec", "b_rec", merge.match_score("a_", "b_", keyed=True).alias("score")).where("score > 0")


def _fold(spark: SparkSession, sf_dir: str, events: bool = True) -> DataFrame:
    return merge.folded(_all(spark, sf_dir), events=events)


@query()
def e03_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event each record of five feeds comes to, with its score when it came."""
    return _fold(spark, sf_dir, events=False).select("rec", "cluster", F.round("score", 2).alias("score"))


@query()
def e04_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged events of five feeds."""
    return merge.events_of(_fold(spark, sf_dir)).drop("sourceDetails").withColumn("sources", F.array_join("sources", "; "))


@query()
def a05_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each feed began an event or joined one."""
    sources = _all(spark, sf_dir).select("rec", C("sources")[0].alias("source"))
    return merge.fold_statistics(_fold(spark, sf_dir, events=False), sources)


@query(f"select rec, date, status from (select *, case when confidence >= 94 then 'confirmed' else 'probable' end as status from ({_LV})) where regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and date < '2022-06-01'")
def e05_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier agenda keeps of the days that are over."""
    return merge.historical(_records(spark, sf_dir, "lasventas", "Las Ventas oficial", 0), "2022-06-01").select("rec", "date", "status")


@query("select 0 as rank, count(*) as n from elmuletazo union all select 1, count(*) from onetoro union all select 2, count(*) from canalsur union all select 3, count(*) from canalextremadura union all select 4, count(*) from lasventas")
def e06_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each feed by its place in the order of the merge."""
    return _all(spark, sf_dir).groupBy("rank").agg(F.count("*").alias("n"))


@query("select source, n, (select count(*) from elmuletazo) + (select count(*) from onetoro) + (select count(*) from canalsur) + (select count(*) from lasventas) as kept from (select 'Canal Extremadura' as source, count(*) as n from canalextremadura)")
def e07_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in quarantine is counted, not merged."""
    kept, held = merge.quarantined(_all(spark, sf_dir), ["Canal Extremadura"])
    return held.join(kept.agg(F.count("*").alias("kept")))


@query(f"select rec from ({_LV}) where not coalesce(contains({canonical_sql('location')}, 'madralba') and len(list_filter(participants, lambda z: contains({_normal('z')}, 'gallededor'))) > 0, false)")
def e08_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without those that a rule excludes: a place together with a person."""
    rule = F.contains(places.canonical_place(C("location")), F.lit("madralba")) & F.exists("participants", lambda p: F.contains(merge.normalized(p), F.lit("gallededor")))
    return merge.excluded(_records(spark, sf_dir, "lasventas", "Las Ventas oficial", 0), rule).select("rec")


@query(f"""with e as materialized (select rec, seq, cast(date as date) as d, {canonical_sql('location')} as place, list_distinct(list_filter(list_transform(participants, lambda z: {_normal('z')}), lambda z: z <> '')) as who, {_normal('breeding')} as herd, seq % 2 = 0 as said
    from ({_EL}) where contentType = 'festejo' and date is not null and confidence >= 90),
  p as (select a.rec as old, b.rec as new, b.seq, {fuzzy_sql('a.herd', 'b.herd')} as herd, case when len(a.who) = 0 or len(b.who) = 0 then 0.0 else len(list_intersect(a.who, b.who))::double / least(len(a.who), len(b.who)) end as people
    from e a join e b on a.place = b.place and datediff('day', a.d, b.d) between 1 and 60 where b.said)
  select old, arg_min(new, seq) as new from p where people >= .34 and (herd >= .72 or people = 1) group by 1""")
def e09_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the later one that replaces them: place, people, breeder, trust, sources and a word of the change."""
    e = _records(spark, sf_dir, "elmuletazo", "El Muletazo", 0)
    e = e.withColumns({"sources": F.array(F.lit("El Muletazo"), F.lit("Aplausos")), "title": F.when(C("seq") % 2 == 0, "Aplazado"), "name": F.lit(""), "eventUrl": F.lit(""), "sourceUrl": F.lit("")})
    return merge.moved(e, most_days=60, least_people=0.34, least_confidence=90)[1]


@query()
def qa_merged_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published agenda: all feeds adapted and folded after the history, exclusions, moved events, order, and the checks each event fails."""
    records = _all(spark, sf_dir)
    past = merge.historical(_records(spark, sf_dir, "lasventas", "Las Ventas oficial", 0), "2015-01-01").withColumn("rec", F.concat(F.lit("past:"), "rec"))
    kept, _ = merge.quarantined(past.unionByName(records), ["Aplausos"])
    events = cut(merge.events_of(merge.folded(kept)))
    events = merge.excluded(events, F.contains(places.canonical_place(C("location")), F.lit("tarifa")) & F.exists("participants", lambda p: F.contains(merge.normalized(p), F.lit("manuel escribano"))))
    events, _ = merge.moved(events)
    checks = {"date": C("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "label": (C("name") != "") | (C("title") != "") | (C("location") != ""), "channel": C("channel") != "", "sources": F.size("sources") > 0}
    failed = quality.violations(events, "rec", checks).groupBy("rec").agg(F.array_join(F.array_sort(F.collect_set("violation")), ",").alias("violations"))
    return merge.in_order(events.join(failed, "rec", "left")).select(
        "rec", "date", "time", "location", "name", "channel", "type", "breeding", F.array_join("participants", "; ").alias("participants"), F.array_join("sources", "; ").alias("sources"), "confidence", "status", F.coalesce("violations", F.lit("")).alias("violations"))


@query()
def e10_shown_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged agenda as it is shown: what is left of it after the second pass, with the number of events in each."""
    shown = cut(display.deduplicated(cut(merge.events_of(_fold(spark, sf_dir)))))
    n = shown.groupBy("cluster").agg(F.count("*").alias("events"))
    return shown.where("rec = cluster").join(n, "cluster").select("rec", "date", "time", "location", "type", "channel", "televised", "breeding", F.array_join("participants", "; ").alias("participants"), "events")
