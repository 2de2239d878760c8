"""The merge: each rung of the score, survivorship, the fold against plain Python, split blocks, history, moved events."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from almagre.operators import display, merge

RAW = "rec string, rank int, seq long, id string, date string, time string, channel string, location string, type string, contentType string, breeding string, name string, title string, participants array<string>, televised boolean, televisionUnconfirmed boolean, deferred boolean, eventUrl string, fetchedAt string, source string"
BLANK = dict.fromkeys(c.split()[0] for c in RAW.split(", "))


def _raw(spark, rows):
    return spark.createDataFrame([tuple({**BLANK, "rec": f"r{i}", "rank": 0, "seq": i, "date": "2025-08-15", "type": "Corrida", "source": "S", **r}[c] for c in BLANK) for i, r in enumerate(rows)], RAW)


def _records(spark, rows):
    return merge.adapted(_raw(spark, rows), F.col("source"))


TOWN, OTHER = "Madralba (Sotomar)", "Pozoalcor (Sotomar)"
RUNGS = [
    (98.0, {"location": TOWN, "participants": ["Ana Pérez", "Luis Gil"]}, {"location": "madralba", "participants": ["ANA PEREZ"]}),
    (94.0, {"location": TOWN, "breeding": "Marqués de Sabiteña"}, {"location": TOWN, "breeding": "Marques de Sabitenna"}),
    (96.0, {"location": "Televisión", "time": "18:00", "channel": "C", "breeding": "Sotolavera"}, {"location": "Jaralosa", "time": "18:00", "channel": "C", "breeding": "Sotolavera"}),
    (97.0, {"location": "Toros 2026", "time": "18:00", "channel": "C"}, {"location": "Jaralosa", "name": "Jaralosa", "time": "18:20", "channel": "C"}),
    (88.0, {"location": "Navalinda", "time": "18:00", "channel": "C"}, {"location": "Navalindo", "channel": "C"}),
    (0.0, {"location": TOWN, "time": "18:00", "channel": "C"}, {"location": OTHER, "time": "18:00", "channel": "C"}),
    (0.0, {"location": TOWN}, {"location": TOWN, "date": "2025-08-16"}), (0.0, {"location": TOWN}, {"location": TOWN, "contentType": "programa"}),
    (101.0, {"location": TOWN, "channel": "C"}, {"location": TOWN, "channel": "C"}), (40.0 + 35 + 18 + 8 + 7 * 0.5, {"location": TOWN, "channel": "C", "time": "18:00"}, {"location": TOWN, "channel": "C", "time": "18:50"}),
]


def _scores(records):
    x, y = (records.select(*[F.col(c).alias(f"{s}{c}") for c in records.columns]) for s in ("a_", "b_"))
    return {(r[0], r[1]): r[2] for r in x.crossJoin(y).select("a_rec", "b_rec", merge.match_score("a_", "b_")).collect()}


def test_each_rung(spark):
    rows = [r for _, a, b in RUNGS for r in (a, b)]
    scores = _scores(_records(spark, rows))
    for i, (expected, *_) in enumerate(RUNGS):
        assert scores[f"r{2 * i}", f"r{2 * i + 1}"] == pytest.approx(expected), RUNGS[i]


def _random(rnd, n, towns):
    people = ["Ana Pérez", "Luis Gil", "Eva Montsador", "Pablo Ruiz", "ana perez"]
    return [
        {
            "date": rnd.choice(["2025-08-15", "2025-08-16"]), "time": rnd.choice(["", "18:00", "18:20", "19:00", None, "x"]), "channel": rnd.choice(["Canal Sur TV", "Tele Dehesa", "Sin TV", None]),
            "location": rnd.choice(towns), "type": rnd.choice(["Corrida de toros", "Novillada", "", "Programa"]), "breeding": rnd.choice(["Sotolavera", "Ganadería: Sotolabera", "Encinibre", "", None]),
            "name": rnd.choice(["", "Feria", "Toros"]), "title": rnd.choice([None, "Gran corrida"]), "participants": rnd.choice([None, [], rnd.sample(people, 2), rnd.sample(people, 3)]),
            "televised": rnd.choice([None, True, False]), "source": rnd.choice(["Canal Sur", "El Muletazo", "Las Ventas oficial", "Q"]), "rank": rnd.randint(0, 3),
        }
        for _ in range(n)
    ]


def test_the_fold_is_that_of_the_scores(spark):
    """Folded in order by hand: the column's score of the merged record so far against the next one."""
    rnd = random.Random(3)
    records = _records(spark, _random(rnd, 8, ["Madralba (Sotomar)", "Madralba", "Jaralosa", "Televisión", ""])).cache()
    got = {r.rec: (r.cluster, r.score) for r in merge.folded(records).collect()}
    rows = sorted(records.collect(), key=lambda r: (r["rank"], r.seq))
    kept: list[dict] = []
    for row in rows:
        e = row.asDict(recursive=True)
        scores = []
        if kept:
            df = spark.createDataFrame([{**k, "rec": k["rec"]} for k in kept] + [e], records.schema)
            scores = [(s, -i) for i, k in enumerate(kept) for (a, b), s in _scores(df).items() if a == k["rec"] and b == e["rec"]]
        best, at = max(scores, default=(0.0, 0))
        if best >= merge.RULES.least[e["contentType"]]:
            assert got[e["rec"]] == (kept[-at]["rec"], pytest.approx(best))
            keys = {"place_": "", "match_": "", "channel_": "", "minute_": None}
            one = merge._merged({**kept[-at], **keys}, {**e, **keys}, merge.RULES)
            kept[-at] = {**{c: one[c] for c in merge.EVENT}, "rec": kept[-at]["rec"], "rank": kept[-at]["rank"], "seq": kept[-at]["seq"]}
        else:
            assert got[e["rec"]][0] == e["rec"]
            kept.append(e)
    events = {r.rec: r.asDict(recursive=True) for r in merge.events_of(merge.folded(records)).collect()}
    assert {k["rec"]: (k["location"], k["breeding"], k["participants"], k["confidence"]) for k in kept} == {rec: (e["location"], e["breeding"], e["participants"], e["confidence"]) for rec, e in events.items()}


def test_split_blocks_fold_alike(spark):
    towns = ["Madralba (Sotomar)", "Madralba", "Jaralosa", "Jaralosas", "Olmedalvo del Campo", "Olmedalvo de Arriba", "Pozoalcor"]
    for also in ([], ["Televisión"]):
        records = _records(spark, _random(random.Random(8), 120, towns + also)).cache()
        whole, parts = ({tuple(r) for r in merge.folded(records, large=n).select("rec", "cluster", "location", "breeding", "confidence").collect()} for n in (10_000, 5))
        assert whole == parts and len({r[1] for r in whole}) < len(whole)


def _one(spark, *rows):
    out = merge.events_of(merge.folded(_records(spark, list(rows)))).collect()
    assert len(out) == 1
    return out[0]


def test_survivorship(spark):
    both = {"location": TOWN, "participants": ["Ana Pérez", "Luis Gil"]}
    e = _one(spark, {**both, "channel": "Sin TV", "source": "Mundotoro", "televisionUnconfirmed": True}, {**both, "channel": "Canal Sur", "time": "18:00", "source": "Canal Sur", "deferred": True, "participants": ["Luis Gil Pérez", "Luis Gil", "Eva Soto"]})
    assert (e.channel, e.televised, e.televisionUnconfirmed, e.deferred, e.time, e.sources, e.title) == ("Canal Sur", True, False, True, "18:00", ["Mundotoro", "Canal Sur"], None)
    assert e.participants == ["Ana Pérez", "Luis Gil", "Luis Gil Pérez", "Eva Soto"] and e.confidence == 100 and e.status == "confirmed"
    assert [(d.name, d.confidence) for d in e.sourceDetails] == [("Mundotoro", 86), ("Canal Sur", 98)]
    e = _one(spark, {**both, "breeding": "A B", "time": "18:00", "source": "Canal Sur"}, {**both, "breeding": "Z", "participants": ["Ana Pérez"], "source": "Las Ventas oficial"})
    assert (e.breeding, e.participants) == ("Z", ["Ana Pérez"])
    e = _one(spark, {"location": "Televisión", "channel": "C", "time": "18:00", "title": "Uno"}, {"location": "Jaralosa", "channel": "C", "time": "18:10", "title": "Dos"})
    assert (e.location, e.title) == ("Jaralosa", None)


def test_rows_without_date_and_empty_tables(spark):
    records = _records(spark, [{"date": None, "location": TOWN}] * 3 + [{"date": "", "location": None, "participants": [None, ""], "name": "x" * 5000}])
    fold = merge.folded(records).collect()
    assert sorted(r.rec for r in fold if r.rec == r.cluster) == ["r0", "r1", "r2", "r3"]
    assert merge.folded(records.limit(0)).count() == merge.moved(records.limit(0))[0].count() == 0


def test_history_quarantine_exclusion_and_statistics(spark):
    records = _records(spark, [{"location": TOWN, "date": d, "source": s} for d, s in (("2025-01-01", "A"), ("2025-12-01", "A"), ("2025-01-01", "B"), ("bad", "A"))])
    assert [(r.rec, r["rank"]) for r in merge.historical(records, "2025-06-01").where("sources[0] = 'A'").collect()] == [("r0", -1)]
    kept, held = merge.quarantined(records, ["B"])
    assert kept.count() == 3 and [tuple(r) for r in held.collect()] == [("B", 1)]
    assert merge.excluded(records, F.col("date") == "bad", F.col("image") == "x").count() == 3
    fold = merge.folded(records)
    got = {r.source: (r.added, r.merged) for r in merge.fold_statistics(fold, records.select("rec", F.col("sources")[0].alias("source"))).collect()}
    assert got == {"A": (3, 0), "B": (0, 1)}


def test_moved_events(spark):
    base = {"location": TOWN, "participants": ["Ana Pérez", "Luis Gil", "Eva Soto"], "breeding": "Sotolavera", "source": "Canal Sur"}
    rows = [{**base, "date": "2025-08-15"}, {**base, "date": "2025-08-20", "name": "Aplazado"}, {**base, "date": "2025-08-22", "name": "Nueva fecha"}, {**base, "date": "2025-09-30", "name": "Aplazado"}, {**base, "date": "2025-08-19", "location": OTHER, "name": "Aplazado"}]
    events = _records(spark, rows).withColumn("sources", F.array(F.lit("Canal Sur"), F.lit("B")))
    kept, links = merge.moved(events)
    assert {tuple(r) for r in links.collect()} == {("r0", "r1"), ("r1", "r2")} and sorted(r.rec for r in kept.collect()) == ["r2", "r3", "r4"]
    assert merge.moved(events.withColumn("sources", F.array(F.lit("A"))))[1].count() == 0
    other = events.withColumn("participants", F.when(F.col("rec") == "r0", F.array(F.lit("X Y"))).otherwise(F.col("participants")))
    assert {tuple(r) for r in merge.moved(other)[1].collect()} == {("r1", "r2")}
    assert list(itertools.islice((r.rec for r in merge.in_order(events).collect()), 3)) == ["r0", "r4", "r1"]


def test_shown_events(spark):
    base = {"location": TOWN, "participants": ["Ana Pérez", "Luis Gil"], "type": "Corrida", "source": "A"}
    rows = [
        {**base, "channel": "Sin TV", "title": "uno", "breeding": "Sotolavera"}, {**base, "channel": "Tele Dehesa", "location": "Plaza de toros Madralba (Sotomar)", "participants": ["ANA PEREZ"], "time": "18:00", "source": "B"},
        {**base, "location": "Plaza de toros, Madralba (Sotomar)", "participants": [], "breeding": "Ganadería: Sotolavera de la Sierra"}, {**base, "type": "Novillada"}, {**base, "participants": ["X Y"], "breeding": "Z"},
        {**base, "contentType": "programa"}, {**base, "contentType": "programa"}, {**base, "date": None}, {"location": "", "name": "", "participants": ["Ana Pérez"]},
    ]
    got = {r.rec: r for r in display.deduplicated(_records(spark, rows)).collect()}
    assert {k: r.cluster for k, r in got.items()} == {"r0": "r0", "r1": "r0", "r2": "r0", **{f"r{i}": f"r{i}" for i in range(3, 9)}}
    e = got["r0"]
    assert (e.channel, e.televised, e.time, e.location, e.breeding, e.participants, e.sources) == ("Tele Dehesa", True, "18:00", "Plaza de toros, Madralba (Sotomar)", "Sotolavera", ["ANA PEREZ"], ["A", "B"])
    assert display.deduplicated(_records(spark, rows).limit(0)).count() == 0


def test_all_scores_at_once_are_those_of_each_pair():
    """The best of a block's events found by columns is the one found pair by pair; merged events replace theirs."""
    rnd = random.Random(1)
    places_ = ["Madralba", "Jaralosa", "Televisión", "", "Toros 2026", "Navalinda del Campo", "Navalinda de la Sierra", "Jaralosas", "x" * 70, "x" * 64, None]

    def side():
        place = rnd.choice(places_)
        return merge._Side({
            "location": place, "name": rnd.choice(["", "Feria", "Toros"]), "title": rnd.choice([None, "Gran"]), "channel_": rnd.choice("ab"), "place_": merge._plain(place), "match_": merge._plain(place) + rnd.choice(["", "s"]),
            "minute_": rnd.choice([None, 600, 620, 700]), "participants": rnd.sample(["Ana", "Luis", "Eva", "Pablo"], rnd.randint(0, 3)), "breeding": rnd.choice(["", "Sotolavera", "Sotolabera", None]), "time": rnd.choice(["", "10:00", "10:20", None]),
        })

    for event in (True, False):
        sides = [side() for _ in range(200)]
        columns, kept = merge._Kept(sides, event, merge.RULES), []
        for s in sides:
            best, at = max(((merge._score(k, s, event, merge.RULES), -i) for i, k in enumerate(kept)), default=(0.0, 1))
            assert columns.best(s) == (best, -at if best else -1)
            if best and rnd.random() < 0.3:
                kept[-at] = s
                columns.put(s, -at)
            else:
                kept.append(s)
                columns.put(s)


def test_scores_with_keys_are_those_without(spark):
    records = _records(spark, [r for _, a, b in RUNGS for r in (a, b)])
    x, y = (merge.score_keys(records).select(*[F.col(c).alias(f"{s}{c}") for c in merge.score_keys(records).columns]) for s in ("a_", "b_"))
    assert {(r[0], r[1]): r[2] for r in x.crossJoin(y).select("a_rec", "b_rec", merge.match_score("a_", "b_", keyed=True)).collect()} == _scores(records)
