"""Mapping to a reference list: repairs, abbreviations, several entries, none; edit distance against brute force."""

import random

from almagre.llm import canonical_map as cm

REFS = [
    ("channel", 1, "Canal Ribera", "CRIB"), ("channel", 2, "Canal Vega Alta", None), ("channel", 3, "Radiotelevisión Olivar", "RTVO"), ("channel", 4, "Televisión Levantina", "TVL"), ("channel", 5, "Sierra Norte Televisión", None), ("channel", 6, "Costa Media", None),
    ("type", 10, "Corrida de toros", None), ("type", 11, "Novillada con picadores", "picada"), ("type", 12, "Novillada sin picadores", "sin caballos"), ("type", 13, "Corrida mixta", None), ("type", 14, "Encierro", None),
    ("place", 20, "Valdeplata (Albarrena)", None), ("place", 21, "Valdeplata (Tierra Parda)", None), ("place", 22, "Hontanedo del Campo (Vegalonga)", None), ("place", 23, "Madralba (Altozano Real)", None),
]
MEANT = [
    ("channel", "CANAL RIBERA HD", {1}), ("channel", "C. Ribera", {1}), ("channel", "Canal Rivera", {1}), ("channel", "Canal Vegaalta", {2}), ("channel", "R.T.V.O.", {3}), ("channel", "Radio Televisión Olivar", {3}),
    ("channel", "Canal V. Alta y Costa Mdia", {2, 6}), ("channel", "Costa Media / Canal Ribera", {1, 6}), ("channel", "Sin TV", {0}), ("channel", "Televisión", {0}), ("channel", "Canal Estepa", {0}), ("channel", "", {0}), ("channel", "TV Sierra Norte", {5}),
    ("type", "Novillada s/p", {12}), ("type", "Nov. con picadores", {11}), ("type", "Novillada picada", {11}), ("type", "Mixta", {13}), ("type", "Toro de fuego", {0}), ("type", "Encierro a pie", {14}), ("type", "Corrda de toros", {10}), ("type", "Certamen de novilladas sin caballos", {12}),
    ("place", "Valdeplata, Tierra Parda", {21}), ("place", "Albarrena: Valdepalta", {20}), ("place", "Valdeplata", {0}), ("place", "hontanedo del campo", {22}), ("place", "Hontanedo (Vegalonga)", {0}), ("place", "Hontanedo de Arriba (Vegalonga)", {0}),
    ("place", "Plaza de toros de Madralba (Alto.)", {23}), ("place", "Madralba (Altozano Real) Feria de San Blas", {23}), ("place", "Hontanedo edl Campo (Vegalonga)", {22}), ("place", "w" * 5000, {0}),
    ("place", "".join(chr(97 + i * i % 26) for i in range(5000)), {0}),
]


def _refs(spark):
    return spark.createDataFrame(REFS, "kind string, ref_id long, label string, aka string")


def test_values_mean_their_entries(spark):
    values = [(k, v, 1) for k, v, _ in MEANT] * 2 + [("channel", None, 1)]
    got: dict = {}
    for r in cm.mapped(spark.createDataFrame(values, "kind string, value string, token int"), _refs(spark), cm.RULES).collect():
        got.setdefault((r.kind, r.value), set()).add(r.ref_id)
    assert got == {(k, v): m for k, v, m in MEANT}


def test_empty_tables(spark):
    refs, none = _refs(spark), spark.createDataFrame([], "kind string, value string")
    assert cm.mapped(none, refs, cm.RULES).count() == 0
    some = spark.createDataFrame([("type", "Encierro")], "kind string, value string")
    assert [r.ref_id for r in cm.mapped(some, refs.limit(0), cm.RULES).collect()] == [0]


def _osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_repairs_are_all_within_the_edit_distance(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 12)))
    tokens, words = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    got = {
        (r.token, r.word)
        for r in cm.repaired_tokens(
            spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w, False) for w in words], "word string, plain boolean")
        ).collect()
    }
    expected = {(t, w) for t in tokens for w in words if t == w or (set(w) & set("a") and _osa(t, w) <= cm.most_edits(len(w)))}
    assert got == expected


def test_long_words_are_repaired_like_short_ones(spark):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abce") for _ in range(n)) for n in (10, 62, 63, 64, 65, 66, 67, 90, 131, 400)})

    def slip(w):
        i = rnd.randrange(1, len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    tokens = sorted({t for w in words for _ in range(12) for t in (w, slip(w), slip(slip(w)), slip(slip(slip(w))))})
    got = {
        (r.token, r.word)
        for r in cm.repaired_tokens(
            spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w, False) for w in words], "word string, plain boolean")
        ).collect()
    }
    assert got == {(t, w) for t in tokens for w in words if abs(len(t) - len(w)) < 4 and _osa(t, w) <= cm.most_edits(len(w))}
