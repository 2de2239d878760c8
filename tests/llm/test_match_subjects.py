"""Cross-source matching and subjects on made-up data with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from almagre.llm import entity_match as em
from almagre.llm import subjects as sj

FIRST = "Ana Luis Eva Pablo Julián Rocío Diego Marcos Óscar Elías Hugo Irene".split()
LAST = "Gallededor Murciboche Zamaloche Escagobre Montsador Hervamivera Barredolar Castalevera Ubiebil Quintatalar Frailitín Somoroba Delgacol Oñeroga Yebebices Torrenimez".split()
TOWNS = "Madralba Valdeplata Hontanedo Navalinda Fuentelar Santolaya Guadaparra Olmedalvo Jaralosa Pozoalcor".split()
HERDS = "Sotolavera Encinibre Sabiteña Losatejo Picamagal Cañidenes Reguenoga Borbosajo".split()
SCHEMA = "rec string, feed string, days array<int>, time string, location string, title string, participants array<string>, breeding string"


def _festejos(n, seed=1):
    rnd, rows, truth = random.Random(seed), [], set()
    for i in range(n):
        day, people = rnd.randint(8000, 8400), [f"{rnd.choice(FIRST)} {rnd.choice(LAST)}" for _ in range(rnd.choice([2, 3, 6]))]
        town, herd, time = rnd.choice(TOWNS), rnd.choice(HERDS), f"{rnd.randint(11, 22)}:00"
        a, b, c = f"elmuletazo:{i}", f"onetoro:{i}", f"vadetoros:{i}"
        rows.append((c, "vadetoros", [day], time, f"{town} (Sotomar)", None, people, f"Marqués de {herd}"))
        if i % 3:
            typed = [p.upper() if rnd.random() < 0.3 else p.replace("ll", "l") if rnd.random() < 0.1 else p for p in people]
            rows.append((a, "elmuletazo", [day + (i % 10 == 1)], time, town, None, typed, rnd.choice([None, f"Mqués. de {herd}"])))
            truth.add((a, c))
        if i % 2:
            rows.append((b, "onetoro", [day], "", None, f"Feria de San Blas – {town}", [*people, "Corrida de toros", f"Marqués de {herd}", town], None))
            truth.add((b, c))
            if i % 3:
                truth.add((a, b))
    return rows, truth


def test_matches_are_found_with_confidence(spark):
    rows, truth = _festejos(900)
    bad = [("vadetoros:x", "vadetoros", [], "", None, None, None, None), ("elmuletazo:x", "elmuletazo", None, None, "", "", [None, ""], ""), ("onetoro:x", "onetoro", [8000], "", "x" * 50_000, "y" * 50_000, [], "")]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], SCHEMA + ", score int")
    found = em.matches(df).collect()
    got = {(r.rec_a, r.rec_b) for r in found}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97
    assert all(0.5 <= r.confidence <= 1 for r in found)
    assert em.matches(df.limit(0)).count() == 0


def test_feeds_of_any_name_match_alike(spark):
    rows, truth = _festejos(60, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    for names in ({"vadetoros": "alfa", "elmuletazo": "zeta", "onetoro": "beta"}, {"vadetoros": "vadetoros", "elmuletazo": "zeta", "onetoro": "elmuletazo"}):
        renamed = df.replace(names, subset=["feed"])
        found = {(r.rec_a, r.rec_b) for r in em.matches(renamed, least=0.0).collect()}
        assert len(found & truth) / len(truth) > 0.97


def test_close_vectors_always_share_a_key(spark):
    """Multi-index hashing is exact: fewer differing bits than chunks leave one chunk equal."""
    rnd, rows, pairs = random.Random(2), [], []
    for i in range(200):
        v = [rnd.getrandbits(64) - 2**63 for _ in range(em.PEOPLE_LONGS)]
        w = list(v)
        for _ in range(em.PEOPLE_CHUNKS - 1):
            k, bit = rnd.randrange(em.PEOPLE_LONGS), rnd.randrange(64)
            w[k] = ((w[k] + 2**64) ^ (1 << bit)) % 2**64
            w[k] = w[k] - 2**64 if w[k] >= 2**63 else w[k]
        rows += [(2 * i, "a", [100], v, [], []), (2 * i + 1, "b", [103], w, [], [])]
        pairs.append((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "id long, feed string, days array<int>, people array<long>, places array<long>, breeders array<long>")
    left, right = em.index_keys(df, False), em.index_keys(df, True).select("key", "id")
    shared = {(r[0], r[1]) for r in left.join(right.withColumnRenamed("id", "b"), "key").select("id", "b").collect()}
    assert all(p in shared for p in pairs)


def test_scored_pairs_are_those_of_brute_force(spark):
    """Days apart and several slips in every field: no pair that reaches the least score is lost."""
    rnd, rows = random.Random(5), []
    slip = lambda t: "".join(c if rnd.random() > 0.12 else rnd.choice("aeioulnrs") for c in t)
    for i in range(60):
        day, people = rnd.randint(8000, 8010), [f"{rnd.choice(FIRST)} {rnd.choice(LAST)}" for _ in range(3)]
        town, herd = rnd.choice(TOWNS), rnd.choice(HERDS)
        rows.append((f"vadetoros:{i}", "vadetoros", [day], "18:00", f"{town} (Sotomar)", None, people, f"Marqués de {herd}"))
        rows.append((f"elmuletazo:{i}", "elmuletazo", [day + rnd.randint(-4, 4)], "", slip(town), None, [*map(slip, people[: rnd.randint(1, 3)])], f"Marqués de {slip(herd)}"))
    vectors = em.encoded(spark.createDataFrame(rows, SCHEMA)).withColumn("id", F.xxhash64("rec")).cache()
    count = lambda vs: sum((v % 2**64).bit_count() for v in vs)
    dice = lambda x, y: 2 * count([v & w for v, w in zip(x, y, strict=True)]) / (count(x) + count(y))
    best = lambda xs, ys: max((dice([x], [y]) for x in xs for y in ys), default=None)
    all_rows, expected = vectors.collect(), {}
    for a in (r for r in all_rows if r.feed == "elmuletazo"):
        for b in (r for r in all_rows if r.feed == "vadetoros"):
            if abs(a.days[0] - b.days[0]) > em.GAP:
                continue
            parts = [(0.5, dice(a.people, b.people) if a.people and b.people else None), (0.22, best(a.places, b.places)), (0.22, best(a.breeders, b.breeders))]
            parts = [(w, d) for w, d in parts if d is not None]
            score = sum(w * d for w, d in parts) / sum(w for w, _ in parts) if parts else 0
            if score >= em.LEAST_SCORE:
                expected[a.id, b.id] = (abs(a.days[0] - b.days[0]), pytest.approx(score))
    for at_once in (em.AT_ONCE, 7):
        em.AT_ONCE, before = at_once, em.AT_ONCE
        got = em.scored_pairs(vectors.where("feed = 'elmuletazo'"), vectors.where("feed = 'vadetoros'"), em.Weights()).collect()
        em.AT_ONCE = before
        assert {(r.a, r.b): (r.gap, r.score) for r in got} == expected
    assert len(got) == len(expected) and sum(gap > 0 for gap, _ in expected.values()) > 20


def test_calibration_never_falls():
    real, chance = {(0, b): 10 * b + 5 for b in range(10)}, {(0, b): (10 - b) * 3 + (b == 5) * 30 for b in range(10)}
    got = em.calibrated(real, chance)
    values = [got[0, b] for b in range(10)]
    assert values == sorted(values) and 0 <= values[0] < values[-1] <= 1
    assert em.calibrated({}, {}) == {}


WORDS = {
    "sport": "faena muleta estocada oreja ruedo lidia capote vara tendido trofeo".split(), "law": "artículo decreto juzgado recurso multa contrato sanción norma plazo licencia".split(),
    "music": "banda pasodoble partitura clarinete compás coro armonía batuta metales ensayo".split(), "none": "nada más añadir vecina tarde viento calor cita pendiente calendario".split(),
}


def _document(rnd, mix, n=8):
    said = [rnd.choice(mix) for _ in range(n)]
    return ". ".join("Según dijo " + " ".join(rnd.sample(WORDS[s], 5)) for s in said) + ".", said


def test_subjects_on_held_out_documents(spark):
    rnd = random.Random(8)
    docs, labels, held = [], [], {}
    for d in range(500):
        mix = rnd.choice([["sport"], ["law"], ["music"], ["none"], ["sport", "law"], ["music", "none"]])
        text, said = _document(rnd, mix)
        own = {s for s in set(said) - {"none"} if said.count(s) >= 2}
        docs.append((d, text, "clash"))
        if d < 250:
            labels += [(d, s) for s in own or {"none"}]
        else:
            held[d] = own
    docs += [(None, "faena", ""), (900, None, ""), (901, "", ""), (902, "... !", ""), (903, "Según dijo faena muleta estocada. " * 3000, "")]
    about = spark.createDataFrame([(s, " ".join(w[:3])) for s, w in WORDS.items() if s != "none"], "subject string, about string")
    df, lb = spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string")
    got: dict = {}
    for r in sj.subjects_of(df, lb, about, rank=20).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(len(got.get(d, set()) & own) for d, own in held.items())
    assert right / sum(map(len, held.values())) > 0.95 and right / sum(len(got.get(d, set())) for d in held) > 0.95
    assert not {900, 901, 902} & set(got) and got[903] == {"sport"}
    assert sj.subjects_of(df.limit(0), lb, about).count() == sj.subjects_of(df, lb, about.limit(0)).count() == 0
    assert sj.subjects_of(df, lb.limit(0), about, rank=20).count() > 0


def test_sentences_in_capitals_keep_their_words(spark):
    small = sj.terms("el picador de la segunda vara", {})
    assert sj.terms("EL PICADOR DE LA SEGUNDA VARA", {}) == sj.terms("El Picador de la Segunda Vara 12", {}) == small
    assert sj.terms("Ayer Ana Pérez toreaba", {}) == ["ayer", "toreaba", "ayer toreaba"]
    rnd = random.Random(9)
    docs = [(d, _document(rnd, [s], 6)[0]) for d in range(300) for s in [["sport", "law", "music"][d % 3]]]
    labels = [(d, ["sport", "law", "music"][d % 3]) for d in range(200)]
    docs = [(d, t if d < 200 else t.upper() if d < 250 else t.title()) for d, t in docs]
    about = spark.createDataFrame([(s, " ".join(WORDS[s][:3])) for s in ("sport", "law", "music")], "subject string, about string")
    found = sj.subjects_of(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), about, rank=20)
    got = {(r.doc_id, r.subject) for r in found.where("doc_id >= 200").collect()}
    assert got == {(d, ["sport", "law", "music"][d % 3]) for d in range(200, 300)}


def test_numbered_terms_are_the_terms():
    import numpy as np
    import xxhash

    texts = ["El picador de la segunda vara. Ayer Ana Pérez toreaba 12 toros\nEL PICADOR PICADOR", "", "... !", "Uno dos. " * 3, "Sólo", "Año 3 y La Vega: vio a Ana. ¿Qué? 5"]
    numbers = [sj._numbers(t, {}) for t in texts]
    at, term, per_doc = sj._terms_of([np.array(w, dtype=np.uint32).tobytes() for w, _ in numbers], [np.array(e, dtype=np.int32).tobytes() for _, e in numbers])
    number = lambda t: int(np.array([sum(xxhash.xxh32_intdigest(w) << 32 * i for i, w in enumerate(reversed(t.split(" "))))], dtype=np.uint64).view(np.int64)[0])
    every = [s for t in texts for s in sj.sentences(t)]
    assert sorted(zip(at.tolist(), term.tolist(), strict=True)) == sorted((k, number(t)) for k, s in enumerate(every) for t in set(sj.terms(s, {})))
    assert per_doc.tolist() == [len(sj.sentences(t)) for t in texts]


def test_basis_is_the_truncated_svd(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    forms = [(np.unique(rnd.integers(0, 40, rnd.integers(1, 8))).astype(np.int32).tobytes(), int(rnd.integers(1, 5))) for _ in range(200)]
    df = spark.createDataFrame([(bytearray(f), n) for f, n in forms], "form binary, n long")
    idf = rnd.uniform(0.5, 2, 40)
    basis = sj.svd_basis(df, idf, 5, 40)
    x = np.zeros((len(forms), 40))
    space = sj.Space([f for f, _ in forms], idf)
    np.add.at(x, (space.row, space.ids), space.weight)
    x *= np.sqrt([n for _, n in forms])[:, None]
    v = np.linalg.svd(x, full_matrices=False)[2][:5]
    assert np.allclose(np.linalg.svd(v @ basis)[1], 1, atol=1e-2)


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "p8_fill", "p9_found", "p10_found"])
def test_queries_have_their_columns(spark, name):
    from almagre.llm.queries import QUERIES

    columns = {
        "p1_found": "feed string, row_id bigint", "p3_found": "field string, row_id bigint, ref_id bigint", "p4_found": "rec_a string, rec_b string",
        "p5_found": "group_id bigint, field string, feed string, row_id bigint", "p6_found": "name_a string, name_b string",
        "p8_fill": "container_id int, capacity int, bins bigint, tokens bigint, filled double, fullest bigint", "p9_found": "item_id bigint, doc_id bigint", "p10_found": "doc_id bigint, subject string",
    }
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns[name]
    assert df.count() == df.distinct().count()
