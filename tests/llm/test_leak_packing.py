"""Leaks against brute force, the index on random sequences, packing invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almagre.llm import leak_index as li
from almagre.llm import packing as pk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_suffix_array(values):
    text = np.array(values, dtype=np.int64)
    zeros = np.cumsum(text == 0)
    own = [(0, int(z)) if v == 0 else (1, int(v)) for v, z in zip(text, zeros)]
    assert li._suffix_array(text).tolist() == sorted(range(len(own)), key=lambda i: own[i:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=5, max_size=200), st.integers(1, 4))
def test_search_and_locate(values, length):
    text = np.array([*values, 0], dtype=np.int64)
    index = li.FMIndex(text, 5)
    patterns = [(a, *rest) for a in range(1, 6) for rest in [tuple(values[i : i + length - 1]) for i in range(3)] if 0 not in rest and len(rest) == length - 1]
    items, begin = np.array([s for p in patterns for s in p], dtype=np.int64), np.arange(len(patterns)) * length
    which, low, high = index.search(items, begin, length)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
    for k, p in enumerate(patterns):
        places = [i for i in range(len(text) - length + 1) if tuple(text[i : i + length]) == p]
        assert found.get(k, []) == places


def _texts(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Toro", "plaza", "MONTERA", "año", "ruedo", "capote", "el", "la", "sol", "tarde", "feria", "luna"])
    items = [(None, "toro " * 20)] + [(i, " ".join(word() for _ in range(rnd.choice([5, 12, 30])))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(80):
        words = [word() for _ in range(rnd.randint(0, 60))]
        if d % 2:
            own = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(own) - 12))
            cut = own[a : a + rnd.choice([11, 12, 20])]
            words[5:5] = [w.upper() if rnd.random() < 0.3 else w.replace("ñ", "ñ") for w in cut]
        docs.append((d, rnd.choice([", ", " ", "\n", " – "]).join(words), "clash"))
    return items, docs + [(None, docs[1][1], ""), (500, None, ""), (501, "", ""), (502, "toro " * 100_000, ""), docs[1]]


@pytest.mark.parametrize("pass_chars", [10_000, 300])
def test_leaks_against_brute_force(spark, monkeypatch, pass_chars):
    items, docs = _texts(4)
    form = lambda t: [li.word_form(w) for w in li.words_of(t)]
    expected = set()
    for i, t in items:
        ws = form(t)
        for d, text, _ in docs:
            if i is None or d is None:
                continue
            own = f" {' '.join(form(text))} "
            if any(f" {' '.join(ws[a : a + 12])} " in own for a in range(len(ws) - 11)):
                expected.add((i, d))
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    spans = li.leaked_spans(df, it, pass_chars).collect()
    assert {(r.item_id, r.doc_id) for r in spans} == expected
    by_id = {d: t for d, t, _ in docs}
    for r in spans:
        piece = form(by_id[r.doc_id][r.start : r.end])
        assert len(piece) == r.words >= 12
    assert li.leaked_spans(df.limit(0), it).count() == li.leaked_spans(df, it.limit(0)).count() == 0


def test_a_kept_index_finds_the_same(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(li, "SHARD_WORDS", 400)
    items, docs = _texts(5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string, vocabulary string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {(r.item_id, r.doc_id, r.words) for r in li.leaked_spans(d, i).collect()}
    li.kept_index(d.coalesce(2)).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() > 2 and expected
    for chars in (li.PASS_CHARS, 300):
        assert {(r.item_id, r.doc_id, r.words) for r in li.search_kept(index, i, chars).collect()} == expected
    assert li.search_kept(index, i.limit(0)).count() == li.search_kept(index.limit(0), i).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 120))
def test_packing(sizes, capacity):
    parts = pk.first_fit_decreasing(sizes, capacity)
    fill: dict = {}
    for i, part, size, b in parts:
        fill[b] = fill.get(b, 0) + size
    assert all(v <= capacity for v in fill.values())
    assert [sum(s for i, _, s, _ in parts if i == k) for k in range(len(sizes))] == sizes
    assert all(sizes[i] > capacity for i, part, _, _ in parts if part)
    # first fit: no item would fit an earlier bin than its own among whole items in their order
    room: dict = {}
    for i, part, size, b in parts:
        if sizes[i] <= capacity or part == sizes[i] // capacity:
            assert not [x for x, r in room.items() if x < b and r >= size]
            room[b] = room.get(b, capacity) - size
    if sum(sizes):
        assert len(fill) <= 2 * -(-sum(sizes) // capacity) + 1 + sum(s == 0 for s in sizes)


def test_packing_tables(spark):
    docs = [(i, "palabra " * (i % 40), "clash") for i in range(300)] + [(None, "x", "")] + [(400, None, ""), (401, "", ""), (402, "toro " * 3000, ""), (5, "palabra " * 5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens string")
    kinds = spark.createDataFrame([(1, 64), (2, 256), (3, None)], "container_id int, capacity int")
    out = pk.pack(df, kinds, group_docs=100).toPandas()
    assert set(out.container_id) == {1, 2}
    assert (out.groupby(["container_id", "group_no", "bin_no"]).tokens.sum() <= out.groupby(["container_id", "group_no", "bin_no"]).capacity.first()).all()
    enc = pk.encoding(pk.VOCABULARY)
    total = sum(len(enc.encode_ordinary(t or "")) for d, t, _ in docs if d is not None)
    assert out.groupby("container_id").tokens.sum().tolist() == [total, total]
    assert set(out[out.container_id == 1].doc_id) == {d for d, *_ in docs if d is not None}
    assert pk.pack(df.limit(0), kinds).count() == 0
    with pytest.raises(Exception, match="positive"):
        pk.pack(df, spark.createDataFrame([(1, 0)], "container_id int, capacity int")).collect()
