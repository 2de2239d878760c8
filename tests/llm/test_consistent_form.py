"""Consistent form on hand-made and random texts."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almagre.llm import consistent_form as cf

CASES = [
    (None, None), ("", ""), ("Las Ventas", "Las Ventas"),
    ("Ｌａｓ　Ｖｅｎｔａｓ", "Las Ventas"), ("Marqués", "Marqués"), ("a​b­c﻿", "abc"), ("a b c　d", "a b c d"),
    ("Маrqués", "Marqués"), ("Hіеrrоѕ nº 7 у nº 9", "Hierros nº 7 y nº 9"), ("Οlmedo", "Olmedo"), ("beneﬁcio", "beneficio"),
    ("Москва дом", "Москва дом"), ("«Ταύρος»", "«Ταύρος»"), ("«Ταύρος»", "«Ταύρος»"), ("Mосква", "Москва"),
    ("2ª – “x” ‘y’ …", "2ª – “x” ‘y’ …"), ("\U0001f402️", "\U0001f402️"), ("a️", "a"), ("\U0001f468‍\U0001f469", "\U0001f468‍\U0001f469"), ("1️⃣", "1️⃣"),
]


@pytest.mark.parametrize(("value", "expected"), CASES)
def test_cases(value, expected):
    assert cf.consistent(value) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_form_is_stable_and_composed(value):
    form = cf.consistent(value)
    assert cf.consistent(form) == form
    assert unicodedata.is_normalized("NFC", form) or cf._plain.match(value)


@pytest.mark.parametrize("plain", ["Feria de San Telmo", "Marqués de Cañilamón", "ABRIL"])
def test_every_disguise_comes_back(plain):
    for table in (cf.CYRILLIC_LIKE_LATIN, cf.GREEK_LIKE_LATIN):
        back = {v: k for k, v in reversed(table.items())}
        for c in set(plain) & set(back):
            assert cf.consistent(plain.replace(c, back[c])) == plain
    assert cf.consistent("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in plain)) == plain
    assert cf.consistent(unicodedata.normalize("NFD", plain)) == plain


def test_columns_agree_with_the_function(spark, rows):
    values = [v for v, _ in CASES] + ["x" * 200_000 + "​"]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)] + [(99, values[3], "clash")], "row_id long, value string, form string")
    got = {r.row_id: r.f for r in df.select("row_id", cf.consistent_column(F.col("value")).alias("f")).collect()}
    assert got == {**{i: cf.consistent(v) for i, v in enumerate(values)}, 99: cf.consistent(values[3])}
    found = dict(rows(cf.not_consistent(df, "value"), "key", "form"))
    assert found == {i: f for i, f in got.items() if f != {**dict(enumerate(values)), 99: values[3]}[i]}
    assert cf.not_consistent(df.limit(0), "value").count() == 0
    keys = df.select(cf.comparison_key(F.col("value"))).distinct().count()
    assert keys <= len(values)


def test_a_last_line_end_is_not_passed_over(spark):
    from almagre.llm import consistent_form as cf

    ends = ["\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029"]
    df = spark.createDataFrame([(i, f"Ana Pérez{e}") for i, e in enumerate(["", *ends])], "key long, value string")
    assert sorted(r.key for r in cf.not_consistent(df, "value", "key").select("key").collect()) == list(range(1, len(ends) + 1))
    assert all(cf.consistent(f"Ana Pérez{e}") != f"Ana Pérez{e}" for e in ends)
