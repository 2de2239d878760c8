"""Names, their variants, surviving values and truth discovery on small tables."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from almagre.llm import name_variants as nv
from almagre.llm import names as nm
from almagre.llm import slips
from almagre.llm import survivors as sv


@pytest.mark.parametrize("text", [None, "", " ", "-", "Por confirmar", "Ganadería por designar", "Marqués de...", "Viuda de Le (…)", "Conde de X Leer más", "Menú | Abonos", "Entradas desde 18 €", "y un tercero por designar", "SUSPENDIDO EL DESFILE Ver"])
def test_unusable(text):
    assert not nm.usable(text)


@pytest.mark.parametrize("text", ["Marqués de Sabiteña", "Ana Pérez", "Explotaciones X, S.L.", "Canal Ribera", "Feria de San Blas – 2ª de abono"])
def test_usable(text):
    assert nm.usable(text)


def test_channels():
    assert nm.names_channel("Canal Ribera") and not any(map(nm.names_channel, ("Sin TV", "Televisión", "Por confirmar", "", None)))


def test_parsing():
    assert nm.breeder("Tejogones, herederos de").rest == nm.breeder("Hdros. de Tejogones").rest == ("tejogones",)
    assert "ganaderia" in nm.breeder("Rincóncez (ganadería)").heads and nm.breeder("Explot. Sotolavera, S.L.").rest == ("sotolavera",)
    assert nm.person("Pérez Gil, Ana") == nm.person("ana perez gil") == nm.person("ANA PÉREZ GIL")
    assert nm.person("A. Pérez").short and not nm.person("Ana Pérez").short
    for other in ("Leer más", "Corrida de toros", "Madralba", "Alcubera la Nueva", "", "1 2", "Festival benéfico"):
        assert nm.person(other) is None


GROUPS = [
    {"Víctor Gallededor": 90, "victor galeldedor": 5, "VÍCTOR GALLEDEDOR": 4, "Gallededor, Víctor": 3, "V. Gallededor": 3, "Víc. Gallededor": 2},
    {"Andrés Zamaloche": 50, "Andrés Zamalohce": 3}, {"Germán Zamaloche": 60, "G. Zamaloche": 3},
    {"Francisco Somoteba": 70, "Paco Somoteba": 5, "Curro Somoteba": 5, "F. Somoteba": 4}, {"Hilario Escagobre Escana": 40, "Hilario Escagobre": 4, "Hilario Escagobre E.": 2},
    {"Saúl Peñagable": 30, "Saúúl Peñagable": 3, "S. Peñagable": 3},
    {"Marcos Barredolar": 30}, {"Manuel Barredolar": 30}, {"M. Barredolar": 3},
    {"Marqués de Sabiteña": 80, "Mqués. de Sabiteña": 4, "MARQUÉS DE SABITEÑA": 4, "Marqués de Sabiteñaa": 2}, {"Marquesa de Sabiteral": 70, "Mqsa. de Sabiteral": 3},
    {"Herederos de Tejogones": 60, "Tejogones, herederos de": 5, "Hros. de Tejoogones": 4}, {"Hermanos Chapagoles": 30, "Chapagoles Hermanos": 3},
]


def test_variants_of_one_name_are_linked_and_no_others(spark):
    spellings = [(s, n, "clash") for g in GROUPS for s, n in g.items()]
    noise = [("Leer más", 9, ""), (None, 1, ""), ("", 2, ""), ("Corrida de toros", 99, ""), ("Marqués de...", 3, ""), ("x" * 20_000, 1, ""), ("Ana " + "xy" * 50_000, 1, ""), ("Viuda de " + "xy" * 50_000, 1, "")]
    df = spark.createDataFrame(spellings + noise + [("Víctor Gallededor", 1, "")], "spelling string, n long, kind string")
    expected = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert {tuple(r) for r in nv.variant_pairs(df).collect()} == expected
    assert nv.variant_pairs(df.limit(0)).count() == 0


def test_common_suffixes_are_refined_not_dropped(spark):
    names = [f"{g} {s}gallededor" for g in ("Ana", "Luis", "Eva") for s in ("Mont", "Ber", "Cor", "Ser", "Tor")]
    df = spark.createDataFrame([(n.title(), 10) for n in names] + [(n.title()[:-1] + "t", 1) for n in names], "spelling string, n long")
    nodes = nv.parsed(df).withColumn("node", F.xxhash64("spelling"))
    full, refined = ({tuple(r) for r in nv.candidate_pairs(nodes, c).collect()} for c in (10_000, 5))
    at = {r.spelling: r.node for r in nodes.collect()}
    assert refined <= full
    assert all((at[n.title()], at[n.title()[:-1] + "t"]) in refined for n in names)


def _links(nodes, pairs):
    """The candidate pairs that compare() accepts."""
    at = {r.node: r for r in nodes.collect()}
    own = lambda r: (r["head"], r.heads, r.rest)
    return {
        (at[a].spelling, at[b].spelling) for a, b in pairs
        if a in at and b in at and at[a].kind == at[b].kind and nv.compare(at[a].kind, *own(at[a]), *own(at[b])) is not None
    }


def test_refined_blocks_keep_all_links(spark):
    heads = ["Francisco", "Paco", "Curro", "Pepe", "José", "Nacho", "Ignacio", "Fracnisco", "Rrancisco", "F.", "Fco.", "Ana", "Ama", "María", "Naría", "Mª", "M."]
    names = [f"{h} Gallededor{s}" for h in heads for s in ("", " López", " Lópes", " L.", " Gil")] + [f"{t} de Gallededor" for t in ("Marqués", "Mqués.", "Viuda", "Vda.")]
    df = spark.createDataFrame([(n, 1) for n in names], "spelling string, n long")
    nodes = nv.parsed(df).withColumn("node", F.xxhash64("spelling")).cache()
    every = [(a.node, b.node) for a in nodes.collect() for b in nodes.collect() if a.node != b.node]
    found = _links(nodes, [tuple(r) for r in nv.candidate_pairs(nodes, 3).collect()])
    assert found == _links(nodes, every) and ("Paco Gallededor", "Francisco Gallededor") in found and ("Ana Gallededor", "Ana Gallededor López") in found


def test_slips_in_short_surnames_are_linked(spark):
    slips = {"Perez": ["Pexez", "Peez", "Peerz", "Xerez", "Perex"], "Garcia": ["Gacria", "Garia", "Garxia"], "Gallededor": ["Galldedor"]}
    names = [f"Ana {s}" for full, typed in slips.items() for s in (full, *typed)] + ["Marqués de Perez", "Marqués de Pexez"]
    nodes = nv.parsed(spark.createDataFrame([(n, 1) for n in names], "spelling string, n long")).withColumn("node", F.xxhash64("spelling")).cache()
    every = [(a.node, b.node) for a in nodes.collect() for b in nodes.collect() if a.node != b.node]
    found = _links(nodes, [tuple(r) for r in nv.candidate_pairs(nodes).collect()])
    assert found == _links(nodes, every)
    assert all((f"Ana {t}", f"Ana {full}") in found for full, typed in slips.items() for t in typed) and ("Marqués de Pexez", "Marqués de Perez") in found


def test_no_link_of_a_common_surname_is_lost(spark):
    """A thousand people of one surname, short forms and slips among them: the blocking keeps all that compare() accepts."""
    rnd = random.Random(4)
    given = sorted({"".join(rnd.choice(("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "ro", "su")) for _ in range(rnd.randint(2, 5))).title() for _ in range(2200)})[:1000]
    names = [f"{g} Ruiz" for g in given] + ["Francisco Ruiz", "Paco Ruiz", "Domingo Gomez", "Domingo Gonez", "F. Ruiz", "Fransisco Ruiz", "Francisco Ruiz Gil", "Francisco Ruis"]
    names += ["Ana X" + "xyz" * 100, "Ana X" + "xyz" * 50 + "w" + "xyz" * 50, "Q" + "rst" * 90 + " Lopez", "Q" + "rst" * 45 + "v" + "rst" * 45 + " Lopez"]
    nodes = nv.parsed(spark.createDataFrame([(n, 1) for n in names], "spelling string, n long")).withColumn("node", F.xxhash64("spelling")).cache()
    own = nodes.collect()
    assert len(own) == len(names)
    found = _links(nodes, [tuple(r) for r in nv.candidate_pairs(nodes).collect()])
    every = {(a.spelling, b.spelling) for a in own for b in own if a.node != b.node and a.kind == b.kind and nv.compare(a.kind, a["head"], a.heads, a.rest, b["head"], b.heads, b.rest) is not None}
    assert found == every
    assert {("Paco Ruiz", "Francisco Ruiz"), ("Domingo Gonez", "Domingo Gomez"), (names[-3], names[-4]), (names[-1], names[-2])} - found == set()


def test_letters_lost_are_those_of_the_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(2))
        last = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
            last = row
        most = max(len(a), len(b)) - last[-1]
        assert slips.lost(a, b) == min(2, most)
        assert min(len(a), len(b)) < 3 or most > 1 or slips.Hashed(a).less_one() & slips.Hashed(b).less_one()


_CLAIMS = "group_id long, field string, source string, value string, names int, at timestamp, row_id long"
_DAY = [datetime.datetime(2026, 1, i) for i in (1, 2)]


def test_truth_discovery(spark):
    rows = [(g, "f", s, v, 1, _DAY[0], 0) for g in range(30) for s, v in (("good", "right"), ("also", "right"), ("bad", f"wrong{g}"))]
    rows += [(99, "f", "good", "a", 1, _DAY[0], 1), (99, "f", "bad", "b", 1, _DAY[0], 2), (99, "f", "bad", None, 9, _DAY[1], 3)]
    scored, trust = sv.discovered(spark.createDataFrame(rows, _CLAIMS), "names", "at")
    t = {r.source: r.t for r in trust.collect()}
    assert t["good"] > 0.8 > 0.7 > t["bad"] >= sv.LEAST
    support = {r.value: r.support for r in scored.where("group_id = 99").collect()}
    assert support["a"] > 0.55 > 0.45 > support["b"]
    again, _ = sv.discovered(spark.createDataFrame(rows * 3, _CLAIMS), "names", "at")
    assert {r.value: round(r.support, 9) for r in again.where("group_id = 99").collect()} == {v: round(s, 9) for v, s in support.items()}


def test_a_reliable_source_changes_the_survivor(spark):
    """The same two equal claims survive one or the other way, as their sources are right elsewhere."""
    for right, wrong in (("p", "q"), ("q", "p")):
        rows = [(g, "f", s, v, 1, _DAY[0], 0) for g in range(30) for s, v in ((right, "right"), ("third", "right"), (wrong, f"wrong{g}"))]
        rows += [(99, "f", "p", "a", 1, _DAY[0], 1), (99, "f", "q", "b", 1, _DAY[0], 2)]
        got = {r.group_id: r.value for r in sv.survivors(spark.createDataFrame(rows, _CLAIMS), "names", "at", ["row_id"]).collect()}
        assert got[99] == ("a" if right == "p" else "b") and got[0] == "right"


def test_many_sources_outvote_the_latest_one(spark):
    rows = [(1, "f", f"s{i}", "old", 1, _DAY[0], i) for i in range(40)] + [(1, "f", "late", "new", 1, _DAY[1], 99)]
    rows += [(2, "f", f"s{i}", "old", 1, _DAY[0], i) for i in range(3)] * 500 + [(2, "f", "late", "new", 1, _DAY[1], 99)]
    sv.SPLIT, before = 2, sv.SPLIT
    got = {r.group_id: r.value for r in sv.survivors(spark.createDataFrame(rows, _CLAIMS), "names", "at", ["row_id"]).collect()}
    sv.SPLIT = before
    assert got == {1: "old", 2: "new"}


def test_survivors_are_the_most_complete_then_latest(spark):
    rows = [
        (1, "f", "a", "x", 1, _DAY[1], 1), (1, "f", "b", "y", 2, _DAY[0], 2), (1, "f", "c", "y", 2, _DAY[1], 3),  # most names, then latest
        (2, "f", "a", "x", 1, _DAY[0], 4), (2, "f", "b", "y", 1, _DAY[0], 5), (2, "f", "c", "y", 1, _DAY[0], 6),  # more sources, then the smallest id
        (3, "f", "a", None, 5, _DAY[0], 7), (4, "f", "a", "x", None, None, 8), (4, "f", "b", "z", 1, None, 9),
    ]
    df = spark.createDataFrame(rows, _CLAIMS)
    got = {(r.group_id, r.row_id) for r in sv.survivors(df, "names", "at", ["row_id"]).collect()}
    assert got == {(1, 3), (2, 5), (4, 9)}
    assert sv.survivors(df.limit(0), "names", "at", ["row_id"]).count() == 0


WHOLE = [
    {"Juan de la Torre": 40, "JUAN DE LA TORRE": 4, "De la Torre, Juan": 2, "J. de la Torre": 3, "Juan de la Tore": 2}, {"El Juli": 30, "EL JULI": 3}, {"Morante de la Puebla": 50, "Morante de la Pueblaa": 2},
    {"José Luis de los Reyes Pérez Gil": 20, "José Luis de los Reyes Perez Gil": 3}, {"Antoñete": 30, "Antonete": 3}, {"Ana Bo": 9, "ANA BO": 2},
    {"Herederos de Uno Dos Tres Cuatro Cinco": 9, "Hros. de Uno Dos Tres Cuatro Cinco": 2}, {"El Fandi": 12},
]


def test_names_of_any_form_are_linked(spark):
    """Link words, lone names, short surnames and names of many words are names too."""
    df = spark.createDataFrame([(s, n) for g in WHOLE for s, n in g.items()] + [("Ana y Luis", 3), ("Este sábado", 9), ("Corrida de toros", 9)], "spelling string, n long")
    assert {tuple(r) for r in nv.variant_pairs(df).collect()} == {tuple(sorted(p)) for g in WHOLE for p in itertools.combinations(g, 2)}


def test_people_of_any_form_are_usable():
    from almagre.llm.queries import _people

    for name in ("Juan de la Torre", "El Juli", "Antoñete", "Ana Bo", "José Luis de los Reyes Pérez Gil", "Ana Pérez"):
        assert _people((name, "Luis Gil"))[1] == 2, name
    for other in ("Este sábado", "Corrida de toros", "Herederos de Sabiteña", "Encierro", "Por confirmar", "", None):
        assert _people((other, "Luis Gil"), frozenset(["encierro"])) is None, other
