"""Resolving records of one event: pair scores, best match, ordered folds, survivorship.

Records have rec, seq (a number that orders them), date, kind, time, place, channel, breeding (texts) and participants.
Date, kind and place block the comparison; equal records are compared once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagre.functions.dates import closeness, minutes
from almagre.functions.similarity import fuzzy, rounded, share_of_smaller
from almagre.functions.text import folded, normalized


@dataclass(frozen=True)
class Scoring:
    """Points of a pair of records and what decides at once. Thresholds and points of the scoring."""

    same_people: float = 0.5
    same_breeding: float = 0.72
    by_people: float = 98.0
    by_breeding: float = 94.0
    base: float = 40.0
    place: float = 35.0
    same_place: float = 18.0
    channel: float = 8.0
    time: float = 7.0
    people: float = 12.0
    breeding: float = 5.0
    least: float = 70.0


TIME_STEPS = [(0, 1.0), (30, 0.8), (60, 0.5), (90, 0.25)]


def pair_score(a: str, b: str, s: Scoring = Scoring(), keyed: bool = False) -> Column:
    """The score of two records in columns with the prefixes a and b: decisive agreements first, else points per field. ``keyed``: both have ``herd_, town_, minute_``."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    text = lambda col: normalized(F.coalesce(col, F.lit("")))
    people = share_of_smaller(F.coalesce(x("participants"), F.array().cast("array<string>")), F.coalesce(y("participants"), F.array().cast("array<string>")))
    herd, town, minute = (lambda c: text(c("breeding"))), (lambda c: text(c("place"))), (lambda c: minutes(c("time")))
    if keyed:
        herd, town, minute = ((lambda c, k=k: c(k)) for k in ("herd_", "town_", "minute_"))
    breeding, place = fuzzy(herd(x), herd(y)), fuzzy(town(x), town(y))
    same_place = F.coalesce((x("place") == y("place")) & (x("place") != ""), F.lit(False))
    same_channel = F.coalesce((x("channel") == y("channel")) & (x("channel") != ""), F.lit(False))
    near = closeness(minute(x), minute(y), TIME_STEPS)
    points = s.base + s.place * place + s.time * near + s.people * people + s.breeding * breeding
    points = points + F.when(same_place, s.same_place).otherwise(0.0) + F.when(same_channel, s.channel).otherwise(0.0)
    return (
        F.when((x("date") != y("date")) | (x("kind") != y("kind")) | x("date").isNull() | y("date").isNull(), 0.0)
        .when(same_place & (people >= s.same_people), s.by_people).when(same_place & (breeding >= s.same_breeding), s.by_breeding)
        .otherwise(rounded(points, 2))
    )


def best_matches(left: DataFrame, right: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """For each left record its best right one of the same date and kind, if it reaches the least score.

    Merely similar places can reach it too, so all pairs of a date and kind are scored; records that say the same are scored once.
    """
    said = ("date", "kind", "time", "place", "channel", "breeding", "participants")
    # nulls leave no trace in a hash
    named = F.xxhash64(*said, *[F.col(c).isNull() for c in said], F.size("participants"))
    keyed = left.select("rec", named.alias("h_"), *said)
    a = keyed.groupBy("h_").agg(*[F.first(c).alias(f"a_{c}") for c in said])
    b = right.groupBy(named.alias("b_h")).agg(F.min_by("rec", "seq").alias("b_rec"), F.min("seq").alias("b_seq"), *[F.first(c).alias(f"b_{c}") for c in said])
    # worked out once a record, not once a pair
    text = lambda c: normalized(F.coalesce(F.col(c), F.lit("")))
    a, b = (df.withColumns({f"{p}herd_": text(f"{p}breeding"), f"{p}town_": text(f"{p}place"), f"{p}minute_": minutes(F.col(f"{p}time"))}) for df, p in ((a, "a_"), (b, "b_")))
    pairs = a.join(b, (F.col("a_date") == F.col("b_date")) & (F.col("a_kind") == F.col("b_kind")))
    pairs = pairs.select("h_", "b_rec", "b_seq", pair_score("a_", "b_", s, keyed=True).alias("score")).where(F.col("score") >= s.least)
    best = F.max_by(F.struct("b_rec", "score"), F.struct("score", -F.col("b_seq"))).alias("r")
    found = pairs.groupBy("h_").agg(best)
    return (
        keyed.select(F.col("rec").alias("a_rec"), "h_").join(found, "h_")
        .groupBy("a_rec").agg(F.max_by("r", "r.score").alias("r")).select("a_rec", "r.b_rec", "r.score")
    )


def first_match_clusters(records: DataFrame, least_people: float, block: list[str], buckets: int = 512) -> DataFrame:
    """``(rec, cluster)``: an ordered fold in each block; a record joins the first cluster whose people it shares enough, else begins one.

    A cluster's people grow with its members, so the outcome depends on the order (seq). Records with equal people are folded
    once, so copies of a record don't swell a block; ``buckets`` is the number of calls the blocks are dealt to. Without people a record joins the block's first cluster without people.
    """
    people = F.array_sort(F.array_distinct(F.coalesce("participants", F.array().cast("array<string>"))))
    keyed = records.withColumn("people_", people)
    named = F.xxhash64(*block, *[F.col(c).isNull() for c in block], "people_")  # nulls leave no trace in a hash
    heads = keyed.groupBy(*block, "people_").agg(F.min_by("rec", "seq").alias("head"), F.min("seq").alias("seq"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[tuple, tuple[list, dict]] = {}
        out = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            key = tuple(getattr(r, c) for c in block)
            clusters, index = state.setdefault(key, ([], {}))
            own = set(r.people_)
            near = sorted({i for p in own for i in index.get(p, [])}) if own else [i for i, c in enumerate(clusters) if not c[1]][:1]
            for i in near:
                other = clusters[i][1]
                if not own or len(own & other) / min(len(own), len(other)) >= least_people:
                    break
            else:
                i = len(clusters)
                clusters.append((r.head, set()))
            for p in own - clusters[i][1]:
                index.setdefault(p, []).append(i)
            clusters[i][1].update(own)
            out.append((r.h_, clusters[i][0]))
        return pd.DataFrame(out, columns=["h_", "cluster"])

    # many small blocks are folded in one call; a block is never split
    heads = heads.withColumn("h_", named).withColumn("bucket_", F.pmod(F.xxhash64(*block), F.lit(buckets)))
    folded = heads.groupBy("bucket_").applyInPandas(fold, "h_ bigint, cluster string")
    return keyed.withColumn("h_", named).join(folded, "h_").select("rec", "cluster")


def canonical_place(col: Column) -> Column:
    """A place for comparison: no accents, case or punctuation; the province stays, whether in parentheses or after a comma."""
    bare = F.regexp_replace(folded(col), r"\b(?:espana|plaza de toros|monumental)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[()\[\],.;:]", " "), r"\s+", " "))


def _alike(a: str, b: str) -> float:
    """Of two folded texts: 1 if equal, 0.92 if one contains the other, else the common words over the larger set; 0 if one is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    return 0.92 if a in b or b in a else len(x & y) / max(len(x), len(y))


def same_event_clusters(records: DataFrame, s: Scoring = Scoring(), buckets: int = 512) -> DataFrame:
    """``(rec, cluster)``: an ordered fold of the records of a date, canonical place and kind.

    A record joins the first cluster whose people it shares enough or whose breeding is alike enough, else begins one. A cluster keeps the people and
    the breeding of its first record that has any. Records without a date or place, or with neither people nor breeding, join nothing.
    """
    people = F.transform(F.coalesce("participants", F.array().cast("array<string>")), folded)
    text = lambda c: F.coalesce(folded(F.col(c)), F.lit(""))
    keyed = records.select(
        "rec", "seq", F.col("date").alias("date_"), F.coalesce(canonical_place(F.col("place")), F.lit("")).alias("place_"), text("kind").alias("kind_"),
        text("breeding").alias("breeding_"), F.array_sort(F.array_distinct(F.filter(people, lambda p: p != ""))).alias("people_"),
    )
    alone = F.coalesce(F.col("date_"), F.lit("")).isin("") | (F.col("place_") == "") | ((F.size("people_") == 0) & (F.col("breeding_") == ""))
    block, said = ["date_", "place_", "kind_"], ["date_", "place_", "kind_", "breeding_", "people_"]
    some = keyed.where(~alone).withColumn("h_", F.xxhash64(*said))
    # copies are folded once: they join their first one's cluster
    heads = some.groupBy("h_").agg(F.min_by("rec", "seq").alias("head"), F.min("seq").alias("seq"), *[F.first(c).alias(c) for c in said])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict[tuple, list[list]] = {}
        out = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            clusters, own, breeding = state.setdefault((r.date_, r.place_, r.kind_), []), set(r.people_), r.breeding_
            for c in clusters:
                if (own and c[1] and len(own & c[1]) / min(len(own), len(c[1])) >= s.same_people) or _alike(breeding, c[2]) >= s.same_breeding:
                    c[1], c[2] = c[1] or own, c[2] or breeding
                    break
            else:
                c = [r.head, own, breeding]
                clusters.append(c)
            out.append((r.h_, c[0]))
        return pd.DataFrame(out, columns=["h_", "cluster"])

    # many small blocks are folded in one call; a block is never split
    folded_ = heads.withColumn("bucket_", F.pmod(F.xxhash64(*block), F.lit(buckets))).groupBy("bucket_").applyInPandas(fold, "h_ bigint, cluster string")
    return some.select("rec", "h_").join(folded_, "h_").select("rec", "cluster").unionByName(keyed.where(alone).select("rec", F.col("rec").alias("cluster")))


def survivors(records: DataFrame, cluster: str, score: Column, fields: list[str]) -> DataFrame:
    """One record per cluster: each field from its best-scored member that has it, the first of equals; n members."""
    def best(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.max_by(F.when(filled, F.col(c)), F.struct(filled, score, -F.col("seq"))).alias(c)

    return records.groupBy(cluster).agg(*[best(c) for c in fields], F.count("*").alias("members"))
