"""Pages, answers, grids, entities, cells at the date line, sources and sinks on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from almagre.functions import dates, labels, pages, text
from almagre.operators import joins, listings
from almagre.sources import readers, sinks


def _one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "expected"), [("&#xE9;&#XE9;&#233;", "ééé"), ("&#9999999;&#xD800;&#0;&#99999999999999;", "�" * 4), ("&amp;lt; &lt;", "&lt; <"), (None, None), ("", ""), ("&#x1F402;", "🐂")])
def test_entities(spark, raw, expected):
    assert _one(spark, text.decoded_entities, raw) == expected


def test_json_ld(spark):
    script = lambda x: f'<script type="application/ld+json">{x}</script>'
    assert _one(spark, pages.article_body, script("{broken") + script('[{"a":1},{"articleBody":" x  y "}]')) == "x y"
    assert _one(spark, pages.article_body, script('{"@graph":[{"a":1},{"articleBody":"z"}]}')) == "z"
    assert _one(spark, pages.article_body, "<p>") is None and _one(spark, pages.article_body, None) is None


def test_located_arrays_and_names(spark):
    read = lambda c: F.try_variant_get(pages.located_array(F.try_parse_json(c)), "$", "array<string>")
    assert _one(spark, read, '{"contents":1,"items":["a"],"children":["b"]}') == ["a"] and _one(spark, read, "{}") is None and _one(spark, read, "{") is None
    names = lambda c: pages.flat_names(F.try_parse_json(c))
    assert _one(spark, names, '["a",{"name":"b"},{"displayName":"c"},{"title":" d "},{},null,5,""]') == ["a", "b", "c", "d"]
    assert _one(spark, names, '"x"') == ["x"] and _one(spark, names, '{"title":"t"}') == ["t"] and _one(spark, names, None) == []


def test_public_texts(spark):
    docs = [(1, json.dumps({"a": " x  y ", "id": "no", "b": [{"url": "no", "c": "z"}, "w", 3]})), (2, "{"), (3, None), (4, json.dumps({"a": {"a": {"a": {"a": {"a": {"a": "deep"}, "b": "t"}}}}}))]
    got = {r.k: r.texts for r in pages.public_texts(spark.createDataFrame(docs, "k int, j string"), "k", "j").collect()}
    assert got == {1: ["x y", "z", "w"], 2: [], 3: [], 4: ["t"]}


def test_feeds_and_sitemaps(spark):
    rss = "<item><title>a</title></item><item><title>b</title><link>l</link></item><item><title>c</title><link>m</link></item>"
    assert [i.title for i in _one(spark, lambda c: pages.feed_items(c, 1), rss)] == ["b"]
    site = "<url><loc>https://x/rtva/toros</loc></url><url><loc>https://x/rtva/b</loc><news:title>Corrida</news:title><lastmod>d</lastmod></url><url><loc>https://y/toros</loc></url>"
    assert [(i.title, i.published) for i in _one(spark, lambda c: pages.sitemap_items(c, "/rtva/", "toros|corrida"), site)] == [("https://x/rtva/toros", None), ("Corrida", "d")]


def test_headers_and_their_calendar(spark):
    line = "lunes 3 martes 4 lunes 3 miércoles 5 jueves 6 viernes 7 sábado 8 domingo 9 lunes 3 lunes 10"
    heads = _one(spark, listings.day_headers, line)
    assert [(h.weekday, h.day) for h in heads] == [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8), (0, 9)]
    found = lambda c: F.array_join(F.transform(listings.header_dates(listings.day_headers(c), F.lit("2025-02-01").cast("date")), dates.iso_day), " ")
    assert _one(spark, found, line).split()[0] == "2025-02-03" and _one(spark, found, "lunes 4 martes 5") == "" and _one(spark, found, "") == ""


def test_grid(spark):
    tokens = [("p", i, 100.0 * i, 500.0, 10.0, f"{d} {i + 1}") for i, d in enumerate("Lunes Martes Miércoles Jueves Viernes Sábado Domingo".split())]
    tokens += [("p", 20, -60.0, 300.0, 10.0, "18.30"), ("p", 21, -60.0, 300.4, 10.0, "18.30"), ("p", 22, -60.0, 100.0, 10.0, "20:00"), ("p", 30, 205.0, 310.0, 10.0, "TOROS"), ("p", 31, 215.0, 311.0, 5.0, "del"), ("p", 32, 203.0, 280.0, 5.0, "día"), ("p", 33, 205.0, 200.0, 5.0, "far"), ("q", 1, 5.0, 5.0, 1.0, "TOROS")]
    df = spark.createDataFrame(tokens, "page string, pos int, x double, y double, width double, text string")
    got = {(r.page, r.pos, r.column_no, r.time, r.text) for r in listings.grid_events(df, ["page"], "^TOROS$").collect()}
    assert got == {("p", 30, 2, "18:30", "TOROS del día"), ("q", 1, 0, "", "TOROS")}
    assert listings.grid_events(df.limit(0), ["page"], "x").count() == 0


def test_dates(spark):
    assert _one(spark, dates.spoken_time, "Comienza a las 7") == "07:00" and _one(spark, dates.spoken_time, "desde las 18.30") == "18:30" and _one(spark, dates.spoken_time, "a las 17h") == "17:00" and _one(spark, dates.spoken_time, "25h") is None
    placed = _one(spark, dates.dates_with_places, "el 1/2/2025 y 31/02/2025.")
    assert [(d.text, d.start, d.date is None) for d in placed] == [("1/2/2025", 3, False), ("31/02/2025", 14, True)]
    assert _one(spark, dates.remaining_words, 1501.2, "double") == "1 día, 1 hora y 2 minutos" and _one(spark, dates.remaining_words, -5.0, "double") == "0 minutos" and _one(spark, dates.remaining_words, 60.0, "double") == "1 hora"
    assert _one(spark, lambda c: dates.day_gap(c, F.lit("2025-01-01").cast("date")), None, "date") == float("inf")


def test_labels(spark):
    assert _one(spark, labels.cleaned_breeding, "«Ganadería: ganadería – Conde de&nbsp;X»") == "Conde de X" and _one(spark, labels.cleaned_breeding, "x" * 221) == _one(spark, labels.cleaned_breeding, None) == ""
    assert _one(spark, lambda c: labels.without_prefix_words(c, ["ganader[ií]a", "toros"]), "Toros de la Ganadería: X") == "X"
    assert [_one(spark, labels.lead_time, m, "int") for m in (45, 60, 120, 90)] == ["45 min", "1 hora", "2 horas", "90 min"]


def test_pairs_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 60.0, -179.95), (3, 84.0, 10.0)], "p int, lat double, lon double")
    centres = spark.createDataFrame([(1, 0.0, -179.9), (2, 60.2, 179.9), (3, 84.0, -170.0)], "c int, lat double, lon double")
    assert {(r.p, r.c) for r in joins.within_km(points, centres, 100).collect()} == {(1, 1), (2, 2)}
    assert (3, 3) in {(r.p, r.c) for r in joins.within_km(points, centres, 1500).collect()}


def test_sources_are_isolated(spark, tmp_path):
    event = {"id": "1", "date": "2025-01-01"}
    (tmp_path / "good.json").write_text(json.dumps({"source": "g", "updatedAt": "t", "events": [event, event]}))
    (tmp_path / "cut.json").write_text('{"source": "c", "events": [{"id"')
    (tmp_path / "odd.json").write_text(json.dumps({"source": "o", "events": []}))
    docs, health = readers.isolated(spark, {n: str(tmp_path / f"{n}.json") for n in ("good", "cut", "odd", "none")})
    assert {r.source: (r.ok, r.events) for r in health.collect()} == {"good": (True, 2), "cut": (False, 0), "odd": (True, 0), "none": (False, 0)}
    assert readers.events_of(docs.drop("corrupt")).count() == 2
    sinks.require_source(health)
    with pytest.raises(sinks.Rejected):
        sinks.require_source(health.where("not ok"))


def test_failed_writes_leave_what_was_there(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    none, one, two = spark.range(0), spark.range(1), spark.range(2)
    sinks.gated_write(one, none, [a, b])
    broken = two.select(F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.gated_write(broken, none, [a, b])
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    sinks.gated_write(two, none, [a, b])
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 2
    assert sinks.cached(none, a).count() == 0 and spark.read.parquet(a).count() == 2


def test_streams(spark, tmp_path):
    from almagre.streaming import feeds

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i, "2025-01-0" + str(i)) for i in ids], "id int, date string").coalesce(1).write.mode("append").parquet(source)
        stream = feeds.timely(feeds.deliveries(spark, source, "id int, date string"), "date", "2025-01-02", before=1, after=5)
        feeds.resynchronising(stream, "id", out, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{out}/actions/{n}").collect()}
        assert got == [{(1, "schedule"), (2, "schedule")}, {(1, "cancel"), (3, "schedule")}][n]


def test_header_dates_read_the_headers_once(spark):
    """The headers' expression isn't repeated for each start and place."""
    heads = F.transform(F.array(F.lit(3)), lambda i: F.struct(F.lit(1).alias("weekday"), (i + F.expr("abs(day)")).alias("day")))
    df = spark.createDataFrame([(0,)], "day int").select(listings.header_dates(heads, F.lit("2025-02-01").cast("date")).alias("dates"))
    assert df._jdf.queryExecution().analyzed().toString().count("abs(") == 1
    assert [str(d) for d in df.first().dates] == ["2025-02-03"]
