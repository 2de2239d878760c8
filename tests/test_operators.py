"""Core operators on small tables: edges, nulls, ties, empty inputs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from almagre.functions import arrays, dates, similarity, text
from almagre.operators import dedupe, extract, joins, quality, resolution
from almagre.sources import readers, sinks


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("Ñandú  «Ópera», 2ª", "nandu opera 2ª"), (None, None), ("", ""), ("--", ""), ("ſ ß ø", "ſ ß ø"), ("x" * 100_000, "x" * 100_000)],
)
def test_normalized(spark, value, expected):
    assert _one(spark, text.normalized(F.col("v")), v=value) == expected


def test_entities_and_html(spark):
    assert _one(spark, text.html_text(F.col("v")), v="<p>a&nbsp;&#233;&amp;lt;</p><script>x</script><!-- no -->b<br/>c") == "a é&lt; b c"
    assert _one(spark, text.decoded_entities(F.col("v")), v="&#8364; &euro; &bogus; &") == "€ € &bogus; &"
    assert _one(spark, text.html_escaped(F.col("v")), v="<a href=\"x\">'&'") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;"


@pytest.mark.parametrize(
    ("value", "expected"),
    [("el 3 de mayo de 2024", "2024-05-03"), ("30 de febrero de 2024", None), ("3 de mayor de 2024", None), (None, None), ("", None)],
)
def test_spanish_date(spark, value, expected):
    got = _one(spark, dates.spanish_date(F.col("v")), v=value)
    assert (str(got) if got else None) == expected


@pytest.mark.parametrize(("value", "expected"), [("a las 7:05", "07:05"), ("19h30", "19:30"), ("25:00", None), ("19.30h", "19:30"), ("", None), (None, None)])
def test_hhmm(spark, value, expected):
    assert _one(spark, dates.hhmm(F.col("v")), v=value) == expected


def test_week_dates_across_months_and_years(spark):
    for value, first in (("del 28 de abril al 4 de mayo de 2025", "2025-04-28"), ("Del 29 de diciembre al 4 de enero de 2026", "2025-12-29")):
        assert str(_one(spark, dates.week_dates(F.col("v")), v=value)[0]) == first
    assert _one(spark, dates.week_dates(F.col("v")), v="del 1 al 9 de mayo de 2025") is None


def test_status(spark):
    now = F.lit("2025-08-15 16:20:00").cast("timestamp_ntz")
    for start, expected in (("2025-08-15 14:00", "live"), ("2025-08-15 13:50", "finished"), ("2025-08-15 16:35", "soon"), ("2025-08-15 20:00", "today"), ("2025-08-16 01:00", "tomorrow"), ("2025-09-01 01:00", "future"), (None, "unknown")):
        col = dates.span_status(F.to_timestamp_ntz("v", F.lit("yyyy-MM-dd HH:mm")), F.lit(150), now)
        assert _one(spark, col, v=start) == expected


def test_similarities_of_empty_values_are_zero(spark):
    assert _one(spark, similarity.fuzzy(F.col("a"), F.col("b")), a="", b="") == 0
    assert _one(spark, similarity.fuzzy(F.col("a"), F.col("b")), a=None, b="x") == 0
    assert _one(spark, similarity.fuzzy(F.col("a"), F.col("b")), a="las ventas", b="las ventas") == 1
    empty = F.array().cast("array<string>")
    assert _one(spark, similarity.share_of_smaller(empty, F.array("a")), a="x") == 0


def test_rolling_hash_wraps(spark):
    h = 0
    for c in "una cadena bastante larga":
        h = (31 * h + ord(c)) % 2**32
    assert _one(spark, similarity.rolling_hash(F.col("v")), v="una cadena bastante larga") == h


def test_lists(spark):
    assert _one(spark, arrays.split_names(F.col("v")), v="Ana, Luis y Eva; Ana · e ") == ["Ana", "Luis", "Eva", "e"]
    assert _one(spark, arrays.cleaned(F.col("v"), 5, "no"), v=[" a ", "a", "", "toolong", "no", None]) == ["a"]
    assert _one(spark, arrays.merged(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a")), lambda x, y: x == y), v="") == ["a", "b"]
    assert _one(spark, arrays.chosen(F.col("a"), F.col("b"), F.lit(True)), a="x", b="") == "x"


def test_close_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice(["a", "hot", "hot", None]), rnd.choice([None, *range(0, 600, 7)])) for i in range(200)]
    df = spark.createDataFrame(data, "id int, k string, v int")
    got = {(r.a_id, r.b_id) for r in joins.close_pairs(df, ["k"], "id", "v", 30, F.lit(True)).collect()}
    rows = [r for r in data if None not in r]
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 30}


def test_within_km_against_brute_force(spark):
    import math

    rnd = random.Random(6)
    points, centres = ([(i, rnd.uniform(-70, 70), rnd.uniform(-179, 179)) for i in range(n)] for n in (300, 60))
    km = 900

    def distance(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    got = {(r.p, r.c) for r in joins.within_km(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(centres, "c int, lat double, lon double"), km).collect()}
    assert got == {(p[0], c[0]) for p in points for c in centres if distance(p, c) <= km}


def test_nearest_value(spark):
    points = spark.createDataFrame([(1, "a", 5.0), (2, "a", 4.0), (3, "b", 1.0), (4, "a", -9.0)], "id int, g string, x double")
    anchors = spark.createDataFrame([("a", 3.0), ("a", 5.0), ("a", 7.0)], "g string, anchor double")
    assert {(r.id, r.anchor) for r in joins.nearest_value(points, "x", anchors, "anchor", ["g"]).collect()} == {(1, 5.0), (2, 3.0), (3, None), (4, 3.0)}


def test_first_rule_favourites_spine(spark, rows):
    rules = spark.createDataFrame([(1, "b", "one"), (2, "a", "two")], "rank int, term string, label string")
    df = spark.createDataFrame([(1, "ab"), (2, "a"), (3, None), (4, "")], "id int, t string")
    assert rows(joins.first_rule(df, "t", rules), "id", "label") == [(1, "one"), (2, "two"), (3, None), (4, None)]
    days = joins.spine(spark.createDataFrame([(datetime.date(2025, 1, 2), 1)], "d date, n int"), "d", F.lit("2025-01-01").cast("date"), F.lit("2025-01-03").cast("date"))
    assert [r.n for r in days.orderBy("d").collect()] == [None, 1, None]
    liked = joins.favourites(spark.createDataFrame([("x", ["p"]), (None, None)], "c string, l array<string>"), {"c": ["x"], "l": ["p"]}, ["l"])
    assert [r.matched for r in liked.collect()] == [["c: x", "l: p"], []]


def test_dedupe_ties_nulls_and_clashing_names(spark, rows):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 5, "y"), (3, None, 1, "z"), (4, None, 0, "w")], "pos int, k string, r int, o0 string")
    assert rows(dedupe.keep_first(df, ["k"], "pos"), "pos") == [(1,), (3,)]
    assert rows(dedupe.keep_last(df, ["k"], "pos"), "pos") == [(2,), (4,)]
    assert rows(dedupe.keep_best(df, ["k"], F.col("r"), "pos"), "pos") == [(1,), (3,)]
    assert dedupe.keep_first(df.limit(0), ["k"], "pos").count() == 0


def test_extraction(spark, rows):
    assert _one(spark, extract.blocks(F.col("v"), "(?:LUNES|MARTES)", r"\d"), v="x LUNES 3 a MARTES b LUNES 4") == ["LUNES 3 a ", "LUNES 4"]
    got = _one(spark, extract.lineup(F.col("v"), ["toros de (.*?) para"], ["para (.*)$"]), v="toros de Pérez para Ana, Luis y Eva")
    assert (got.breeding, got.participants) == ("Pérez", ["Ana", "Luis", "Eva"])
    items = spark.createDataFrame([(i, m) for i, m in enumerate([600, 1400, 30, 90, 700, 20, 800])], "pos int, m int").withColumn("g", F.lit(1))
    assert [r.day_index for r in extract.rolled_days(items, ["g"], "pos", "m", 360).orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1, 2]
    dated = spark.createDataFrame([(1, "el 1/2/2025 nada; se emite el 3/4/2025"), (2, "sin fecha"), (3, None)], "id int, t string")
    assert rows(extract.best_dated(dated, "t", "id", [("emite", 4)], 12), "id", "candidate", "score") == [(1, "3/4/2025", 4)]


def _records(spark, data):
    rows = [(f"r{i}", i, d, "festejo", t, p, c, b, w) for i, (d, t, p, c, b, w) in enumerate(data)]
    return spark.createDataFrame(rows, "rec string, seq long, date string, kind string, time string, place string, channel string, breeding string, participants array<string>")


def test_resolution(spark, rows):
    left = _records(spark, [("2025-01-01", "19:00", "Madrid", "A", "X", ["p", "q"]), (None, None, None, None, None, None)])
    right = _records(spark, [("2025-01-01", "12:00", "Madrid", "B", "", ["z"]), ("2025-01-01", "19:00", "Madrid", "A", None, ["p"]), ("2025-01-02", "19:00", "Madrid", "A", "X", ["p", "q"])])
    assert rows(resolution.best_matches(left, right)) == [("r0", "r1", 98.0)]
    many = _records(spark, [("d", None, "P", None, None, w) for w in (["a", "b"], ["b", "c"], ["c"], ["x"], None, [], ["a", "b"])])
    clusters = dict(rows(resolution.first_match_clusters(many, 0.5, ["date", "place"])))
    assert clusters == {"r0": "r0", "r1": "r0", "r2": "r0", "r3": "r3", "r4": "r4", "r5": "r4", "r6": "r0"}


def test_best_matches_are_those_of_the_whole_date(spark, rows):
    import random

    rnd = random.Random(3)
    places = ["Villarroble (Sotomar)", "Villarroble, Sotomar", "Hontanedo de la Sierra", "Hontanedo de la Sierra Feria de los Remedios", "Madralba", "", None]
    made = lambda n: [(f"2025-01-0{rnd.randint(1, 2)}", rnd.choice(["19:00", "19:30", "12:00", None]), rnd.choice(places), rnd.choice("AB"), rnd.choice(["Marqués de X", "", None]), rnd.choice([["p", "q"], ["p"], [], None])) for _ in range(n)]
    left, right = _records(spark, made(40)), _records(spark, made(40))
    a, b = (df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]) for df, p in ((left, "a_"), (right, "b_")))
    every = a.crossJoin(b).withColumn("score", resolution.pair_score("a_", "b_")).where("score >= 70")
    expected = every.groupBy("a_rec").agg(F.max_by(F.struct("b_rec", "score"), F.struct("score", -F.col("b_seq"))).alias("r")).select("a_rec", "r.b_rec", "r.score")
    assert rows(resolution.best_matches(left, right)) == rows(expected)
    one = lambda place, channel: _records(spark, [("2025-01-01", "19:00", place, channel, None, None)])
    assert len(rows(resolution.best_matches(one(places[0], "A"), one(places[1], "B")))) == 1


def test_same_event_clusters(spark, rows):
    data = [
        ("d", None, "Villarroble (Sotomar)", None, "Marqués de X", ["Ana"]), ("d", None, "Villarroble, Sotomar", None, "marques de x", None),
        ("d", None, "Villarroble (Sotomar)", None, None, ["ANA", "Eva"]), ("d", None, "Villarroble (Sotomar)", None, "Otro", ["Luis"]),
        ("d", None, "Villarroble (Sotomar)", None, None, None), ("d", None, "Villarroble (Sotomar)", None, None, []), ("d", None, "", None, "Marqués de X", ["Ana"]),
        (None, None, "Villarroble (Sotomar)", None, "Marqués de X", ["Ana"]), ("d", None, "Villarroble (Sotomar)", None, "Marqués de X", ["Ana"]),
    ]
    records = _records(spark, data)
    got = dict(rows(resolution.same_event_clusters(records)))
    assert got == {"r0": "r0", "r1": "r0", "r2": "r0", "r3": "r3", "r4": "r4", "r5": "r5", "r6": "r6", "r7": "r7", "r8": "r0"}
    other = records.withColumn("kind", F.when(F.col("rec") == "r1", "Novillada").otherwise("Corrida"))
    assert dict(rows(resolution.same_event_clusters(other)))["r1"] == "r1"


def test_quality(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, c string")
    assert rows(quality.violations(df, "id", {"c": F.col("c") != ""})) == [(2, "c")]
    health = quality.source_health(df.withColumn("at", F.lit(1)), "c", "at", ["x", "y"])
    assert rows(health, "c", "n", "status") == [("x", 1, "ok"), ("y", 0, "missing")]


def test_sources_and_sinks(spark, tmp_path, rows):
    import json

    good = {"source": "s", "fetchedAt": "2026-01-01", "events": [{"id": "1", "date": "2026-01-02"}, {"id": "2"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    found, health = readers.isolated(spark, {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "b.json"), "c": str(tmp_path / "none.json")})
    assert rows(health, "source", "ok") == [("a", True), ("b", False), ("c", False)]
    assert rows(readers.events_of(found.where("corrupt is null")), "id", "position", "fetched_at") == [("1", 0, "2026-01-01"), ("2", 1, "2026-01-01")]
    assert readers.optional(spark, str(tmp_path / "none.json"), "a string").count() == 0
    (tmp_path / "x.xml").write_text("<r><item><title>t</title></item><item><title>u</title></item></r>")
    assert rows(readers.xml_rows(spark, str(tmp_path / "x.xml"), "item", "title string")) == [("t",), ("u",)]
    none, some = spark.createDataFrame([], "a int"), spark.createDataFrame([(1,)], "a int")
    assert readers.first_filled(none, some).count() == 1 and readers.with_fallback(none, some).count() == 1 and readers.with_fallback(some, some).count() == 1
    out = str(tmp_path / "out")
    sinks.gated_write(some, none, out)
    with pytest.raises(sinks.Rejected):
        sinks.gated_write(some, some, out)
    with pytest.raises(sinks.Rejected):
        sinks.gated_write(none, none, out)
    assert spark.read.parquet(out).count() == 1
    sinks.write_document(some, str(tmp_path / "doc"))
    assert rows(sinks.resynchronised(some, spark.createDataFrame([(2,)], "a int"), "a")) == [(1, "cancel"), (2, "schedule")]


def test_streams(spark, tmp_path, rows):
    from almagre.streaming import feeds

    start = datetime.datetime(2026, 1, 1)
    for n in range(3):
        data = [(k, start + datetime.timedelta(minutes=10 * n + k), f"v{n}") for k in range(3)]
        spark.createDataFrame(data, "k int, ts timestamp, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.deliveries(spark, str(tmp_path / "in"), "k int, ts timestamp, v string")
    feeds.fold_latest(stream, ["k"], "ts", str(tmp_path / "t"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "t/2")), "k", "v") == [(0, "v2"), (1, "v2"), (2, "v2")]
    counted = feeds.windowed_counts(stream, "ts", "v", "k", "10 minutes", None, "0 seconds")
    counted.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("counted"), "v", "n", "total")[:2] == [("v0", 3, 3), ("v1", 3, 3)]
    moved = feeds.changes(stream.withColumn("k", F.col("k").cast("string")), "k", "v")
    moved.writeStream.format("memory").queryName("moved").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("moved").count() == 9


def test_first_rule_of_many(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 12))) for i in range(120)] + [(999, None), (998, "")]
    rules = [(i, word(rnd.randint(1, 6)), f"l{i}") for i in range(40)]
    df, rl = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(rules, "rank int, term string, label string")
    expected = {(i, next((lb for _, term, lb in rules if t is not None and term in t), None)) for i, t in texts}
    for most in (10_000, 3):
        before, joins.BROADCAST_RULES = joins.BROADCAST_RULES, most
        assert {(r.id, r.label) for r in joins.first_rule(df, "t", rl).collect()} == expected
        joins.BROADCAST_RULES = before


def test_one_large_group_is_sorted_in_ranges(spark):
    rnd = random.Random(12)
    points = [(i, rnd.choice(["a", None]), rnd.uniform(0, 100)) for i in range(3000)]
    anchors = [(g, float(rnd.randint(0, 100))) for g in ("a", None, "b") for _ in range(12)]
    got = {(r.p, r.anchor) for r in joins.nearest_value(spark.createDataFrame(points, "p int, g string, x double"), "x", spark.createDataFrame(anchors, "g string, anchor double"), "anchor", ["g"]).collect()}
    assert got == {(i, min((a for h, a in anchors if h == g), key=lambda a: (abs(a - x), a))) for i, g, x in points}
    items = [(i, "a", rnd.randint(0, 1439)) for i in range(3000)]
    expected, day, last = set(), 0, None
    for i, _, m in items:
        day += last is not None and last < 360 <= m
        last = m
        expected.add((i, day))
    rolled = extract.rolled_days(spark.createDataFrame(items, "i int, g string, m int"), ["g"], "i", "m", 360)
    assert {(r.i, r.day_index) for r in rolled.collect()} == expected
