"""What changed between full snapshots: invertible Bloom lookup tables per hash bucket.

Every record of a snapshot becomes a pair of 64-bit hashes (key, compared values) that falls into three cells
of its bucket's table; a bucket's records of all snapshots lie in one partition, so the tables are built, peeled and read without another shuffle. Each consecutive pair of snapshots gets one subtracted table per bucket, built by one
aggregation; the pairs that only one side holds are peeled out of it. Buckets that can't be peeled are
encoded again in larger tables until all are. Recovered key hashes are classified (added, removed,
changed) and joined back to their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagre.session import cut

# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)

#: Records of one bucket in one snapshot, on average; cells of a bucket's first table (a multiple of 3).
ROWS_PER_BUCKET, FIRST_CELLS, GROWTH = 1024, 768, 4
#: Rows of a counted table (snapshots, failed buckets, recovered keys: up to about 60 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 500_000


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash_longs(*columns: np.ndarray | int) -> np.ndarray:
    """``F.xxhash64`` of bigint columns, as uint64."""
    seed: np.ndarray = np.array([42], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for col in columns:
            x = np.atleast_1d(np.asarray(col, dtype=np.int64)).view(np.uint64)
            h = seed + P5 + np.uint64(8)
            h = _rotl(h ^ (_rotl(x * P2, 31) * P1), 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            seed = h ^ (h >> np.uint64(32))
    return seed


def _cells(key: np.ndarray, digest: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each pair, one row a hash; the table's size also seeds the hashes."""
    part = cells // 3
    return np.stack([xxhash_longs(key, digest, cells * 3 + i).view(np.int64) % part + i * part for i in range(3)])


def peel(n: np.ndarray, key: np.ndarray, digest: np.ndarray, check: np.ndarray) -> tuple[list, list, list, bool]:
    """Key hashes, digests and signs of the pairs in a subtracted table, and whether it came out empty."""
    n, key, digest, check = n.copy(), key.copy(), digest.copy(), check.copy()
    keys: list[int] = []
    digests: list[int] = []
    signs: list[int] = []
    while True:
        at = np.flatnonzero(np.abs(n) == 1)
        at = at[xxhash_longs(key[at], digest[at]).view(np.int64) == check[at]] if len(at) else at
        if not len(at):
            break
        pairs = pd.DataFrame({"k": key[at], "d": digest[at], "s": n[at]}).drop_duplicates(["k", "d"])
        k, d, s = (pairs[c].to_numpy() for c in "kds")
        where, own = _cells(k, d, len(n)), xxhash_longs(k, d).view(np.int64)
        for row in where:
            np.subtract.at(n, row, s)
            np.bitwise_xor.at(key, row, k)
            np.bitwise_xor.at(digest, row, d)
            np.bitwise_xor.at(check, row, own)
        keys += k.tolist()
        digests += d.tolist()
        signs += s.tolist()
    return keys, digests, signs, not (n.any() or key.any() or digest.any() or check.any())


def _peel_groups(cells: int):
    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, later = group
        full = [np.zeros(cells, dtype=np.int64) for _ in range(4)]
        at = pdf["cell"].to_numpy()
        for col, name in zip(full, ("n", "k", "d", "c"), strict=True):
            col[at] = pdf[name].to_numpy()
        keys, digests, signs, whole = peel(*full)
        if not whole:
            return pd.DataFrame({"later": [later], "bucket": [bucket], "k": [0], "d": [0], "change": ["failed"]})
        pairs = pd.DataFrame({"k": keys, "d": digests, "s": signs}, dtype=np.int64).sort_values(["k", "s"])
        by = pairs.groupby("k").agg(low=("s", "min"), high=("s", "max"), d=("d", "last"))  # of a changed key the later digest
        change = np.where(by["low"] != by["high"], "changed", np.where(by["high"] > 0, "added", "removed"))
        return pd.DataFrame({"later": later, "bucket": bucket, "k": by.index.to_numpy(dtype=np.int64), "d": by["d"].to_numpy(), "change": change})

    return run


def snapshot_changes(
    df: DataFrame, snapshot: str, key: str, compared: list[Column], version: str, tie: str,
    rows_per_bucket: int = ROWS_PER_BUCKET, first_cells: int = FIRST_CELLS,
) -> DataFrame:
    """``(key, snapshot, change)`` for each two consecutive snapshots; ``snapshot`` is the later one.

    Of several rows of a key in a snapshot the one with the latest ``version`` counts, then the greatest
    ``tie``. Rows without key or snapshot are left out; nulls in compared values are values like any other
    (map them before where they mean the same). One snapshot or an empty table give no rows. Columns
    besides the named ones pass unread.
    """
    there = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(snapshot).alias("s"), F.col(key).alias("id"),
        F.struct(F.col(version).alias("v"), F.col(tie).alias("t")).alias("order"),
        F.xxhash64(*[F.struct(c.isNull().alias("n"), c.alias("c")) for c in compared]).alias("d"),
    )
    days = cut(there.groupBy("s").count())  # one row a snapshot
    largest = days.agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // rows_per_bucket))
    # deliveries are combined before they are shuffled; then all snapshots of a key share a partition, and no row moves again
    rows = cut(
        there.groupBy("s", "id").agg(F.max_by("d", "order").alias("d"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.xxhash64("id"), F.lit(7)), F.lit(buckets)).cast("int"))
        .repartition("bucket")
    )
    step = days.select("s", F.lag("s").over(Window.orderBy("s")).alias("before"), F.lead("s").over(Window.orderBy("s")).alias("after"))
    sides = F.array_compact(
        F.array(
            F.when(F.col("before").isNotNull(), F.struct(F.col("s").alias("later"), F.lit(1).alias("sign"))),
            F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("later"), F.lit(-1).alias("sign"))),
        )
    )
    sided = (
        rows.withColumn("k", F.xxhash64("id")).join(F.broadcast(step) if days.count() <= BROADCAST_ROWS else step, "s")
        .select("bucket", "id", "k", "d", F.inline(sides))
    )
    found, todo, cells = [], sided, first_cells
    while True:
        part = cells // 3
        hashed = [
            (F.pmod(F.xxhash64("k", "d", F.lit(cells * 3 + i).cast("long")), F.lit(part)) + i * part).cast("int")
            for i in range(3)
        ]
        encoded = (
            todo.drop("id")
            .withColumn("own", F.xxhash64("k", "d"))
            .withColumn("cell", F.explode(F.array(*hashed)))
            .groupBy("bucket", "later", "cell")
            .agg(
                F.sum("sign").alias("n"), F.bit_xor("k").alias("k"),
                F.bit_xor("d").alias("d"), F.bit_xor("own").alias("c"),
            )
        )
        kind = df.schema[snapshot].dataType.simpleString()
        peeled = cut(
            encoded.groupBy("bucket", "later").applyInPandas(
                _peel_groups(cells), f"later {kind}, bucket int, k bigint, d bigint, change string"
            )
        )
        found.append(peeled.where("change <> 'failed'").select("later", "k", "d", "change"))
        failed = peeled.where("change = 'failed'").select("later", "bucket")
        failures = failed.count()
        if not failures:
            break
        todo, cells = sided.join(F.broadcast(failed) if failures <= BROADCAST_ROWS else failed, ["later", "bucket"], "left_semi"), cells * GROWTH
    changes = found[0]
    for more in found[1:]:
        changes = changes.unionByName(more)
    # the recovered digest must be that of the row whose id it names
    changes = changes.withColumn("sign", F.when(F.col("change") == "removed", -1).otherwise(1))
    small = changes.count() <= BROADCAST_ROWS
    return sided.join(F.broadcast(changes) if small else changes, ["later", "k", "d", "sign"]).select(
        F.col("id").alias(key), F.col("later").alias(snapshot), "change"
    )


def hour_and_minute(col: Column) -> Column:
    """A time as HH:MM whatever its separator, padding and unit; null and empty are the same."""
    at = r"^\s*(\d{1,2})\s*[:.hH]\s*(\d{2})"
    hour, minute = F.regexp_extract(col, at, 1), F.regexp_extract(col, at, 2)
    return F.when(F.trim(F.coalesce(col, F.lit(""))) == "", "").otherwise(
        F.when(hour == "", F.trim(col)).otherwise(F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))
    )
