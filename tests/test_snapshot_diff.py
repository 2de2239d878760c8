"""Differences between snapshots against brute force, with bad tables."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagre.operators import snapshot_diff as sd

SCHEMA = "row_id long, s timestamp_ntz, loaded timestamp_ntz, id string, v string, tags array<string>"
DAY = datetime.datetime(2026, 1, 1)


def _brute(rows):
    best = {}
    for row_id, s, loaded, key, v, tags in rows:
        if s is not None and key is not None:
            order = (loaded is not None, loaded or DAY, row_id)
            if (s, key) not in best or order > best[s, key][0]:
                best[s, key] = (order, (v, None if tags is None else tuple(sorted(set(tags)))))
    snaps = sorted({s for s, _ in best})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old, new = ({k: x for (s, k), (_, x) in best.items() if s == at} for at in (a, b))
        out |= {(k, b, "added") for k in new.keys() - old.keys()} | {(k, b, "removed") for k in old.keys() - new.keys()}
        out |= {(k, b, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def _diff(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit(1)).withColumn("k", F.lit("x"))  # clashing names
    compared = [F.col("v"), F.array_sort(F.array_distinct("tags"))]
    return {tuple(r) for r in sd.snapshot_changes(df, "s", "id", compared, "loaded", "row_id", **kw).collect()}


def _random_rows(seed, n=400, change=0.3):
    rnd, rows = random.Random(seed), []
    for day in range(4):
        s = DAY + datetime.timedelta(days=day)
        for i in range(n):
            if rnd.random() < 0.9:
                v = rnd.choice(["a", "b", None, ""]) if rnd.random() < change else f"v{i}"
                for _ in range(1 + (rnd.random() < 0.1)):
                    rows.append((len(rows), s, s + datetime.timedelta(minutes=rnd.randint(0, 99)), f"id{i}", v, rnd.choice([["x", "y"], ["y", "x", "x"], None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_snapshots(spark, seed):
    rows = _random_rows(seed)
    assert _diff(spark, rows) == _brute(rows)


def test_full_buckets_are_enlarged(spark):
    rows = _random_rows(3, change=1.0)
    assert _diff(spark, rows, rows_per_bucket=400, first_cells=12) == _brute(rows)


def test_bad_tables(spark):
    s = [DAY + datetime.timedelta(days=i) for i in range(2)]
    assert _diff(spark, []) == set()
    assert _diff(spark, [(1, s[0], s[0], "a", "x", [])]) == set()
    rows = [(1, s[0], s[0], None, "x", None), (2, None, s[0], "a", "x", None), (3, s[0], None, "a", None, None), (4, s[1], s[1], "a", "", None), (5, s[1], s[1], "b" * 100_000, "y" * 100_000, [])]
    assert _diff(spark, rows) == _brute(rows)


def test_one_key_with_a_third_of_all_rows(spark):
    rows = _random_rows(4)
    rows += [(len(rows) + i, DAY, DAY + datetime.timedelta(minutes=i), "hot", f"{i}", None) for i in range(len(rows) // 2)]
    assert _diff(spark, rows) == _brute(rows)


def test_hash_is_sparks(spark):
    values = [(1, 2), (-5, 7), (2**62, -(2**62))]
    df = spark.createDataFrame(values, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
    for r in df.collect():
        assert int(sd.xxhash_longs(np.array([r.a]), np.array([r.b])).view(np.int64)[0]) == r.h


def test_hour_and_minute(spark):
    df = spark.createDataFrame([("17:30",), (" 17:30",), ("17.30h",), ("7:05 h",), (None,), ("",), ("por la tarde",)], "t string")
    assert [r[0] for r in df.select(sd.hour_and_minute(F.col("t"))).collect()] == ["17:30", "17:30", "17:30", "07:05", "", "", "por la tarde"]
