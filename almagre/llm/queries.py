"""pN_ queries of the operators for text and free-typed data, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagre.llm.canonical_map import RULES, mapped
from almagre.llm.consistent_form import comparison_key, consistent_column, not_consistent
from almagre.llm.entity_match import matches
from almagre.llm.leak_index import kept_index, leaked_spans, search_kept
from almagre.llm.name_variants import entities, variant_pairs
from almagre.llm.names import any_person, breeder, names_channel, person, plain, usable
from almagre.llm.packing import pack
from almagre.llm.sql import SQL  # noqa: F401
from almagre.llm.survivors import survivors
from almagre.llm.subjects import subjects_of
from almagre.operators.snapshot_diff import hour_and_minute
from almagre.session import shared_folder, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose value isn't in consistent form."""
    fields = {"vadetoros": "breeding", "elmuletazo": "location", "onetoro": "name"}
    parts = [
        not_consistent(table(spark, sf_dir, feed), col).select(F.lit(feed).alias("feed"), F.col("key").alias("row_id"))
        for feed, col in fields.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and spellings each comparison key of the three fields stands for."""
    fields = {"vadetoros": "breeding", "elmuletazo": "location", "onetoro": "name"}
    parts = [
        table(spark, sf_dir, feed).where(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
        .select(F.lit(feed).alias("feed"), "value", "n")
        for feed, col in fields.items()
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("form", comparison_key(F.col("value")))
        .groupBy("feed", "form")
        .agg(F.count("*").alias("spellings"), F.sum("n").alias("n_rows"))
    )


#: The town of a place written "Town (Province)" or "Town, Province".
_TOWN = r"^([^(,]+?)\s*[(,]"
# The free-typed fields and the kind of their reference list.
_FREE_FIELDS = (("elmuletazo", "channel", "channel"), ("elmuletazo", "type", "type"), ("vadetoros", "location", "place"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(field, kind, row_id, value)`` of the free-typed values that aren't labels themselves."""
    labels = table(spark, sf_dir, "refvalues").select("kind", F.col("label").alias("value"))
    parts = [
        table(spark, sf_dir, feed).select(
            F.lit(f"{feed}.{col}").alias("field"), F.lit(kind).alias("kind"), "row_id", F.col(col).alias("value")
        )
        for feed, col, kind in _FREE_FIELDS
    ]
    rows = reduce(DataFrame.unionByName, parts).where("value is not null and value <> ''")
    return rows.join(labels, ["kind", "value"], "left_anti")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entries meant by each free-typed value that isn't a label itself; 0 if none."""
    rows = _typed(spark, sf_dir)
    found = mapped(rows, table(spark, sf_dir, "refvalues"), RULES)
    return rows.join(found, ["kind", "value"]).select("field", "row_id", "ref_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no reference entry, with their rows."""
    rows = _typed(spark, sf_dir)
    none = mapped(rows, table(spark, sf_dir, "refvalues"), RULES).where("ref_id = 0")
    counts = rows.groupBy("field", "kind", "value").agg(F.count("*").alias("n_rows"))
    return counts.join(none, ["kind", "value"]).select("field", "value", "n_rows")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The festejos of three feeds in one form; of several deliveries of an id, each field's latest that says something."""
    va, el, on = (table(spark, sf_dir, t) for t in ("vadetoros", "elmuletazo", "onetoro"))
    order = lambda there: F.struct(there, F.col("fetchedAt"), F.col("loaded_at"), F.col("row_id"))
    said = ~F.lower(F.coalesce("location", F.lit(""))).rlike(r"por (confirmar|determinar|anunciar|designar)|sin anunciar|^\s*$")
    some = F.coalesce(F.size("participants"), F.lit(0)) > 0
    text = lambda c: F.coalesce(F.length(c), F.lit(0)) > 1
    day = F.datediff(F.try_to_date("date", "yyyy-MM-dd"), F.lit("2000-01-01").cast("date"))
    one = va.where("id is not null").groupBy("id").agg(
        F.collect_set(day).alias("days"), F.max_by("time", order(text("time"))).alias("time"),
        F.max_by("location", order(said)).alias("location"), F.max_by("participants", order(some)).alias("participants"),
        F.max_by("breeding", order(text("breeding"))).alias("breeding"),
    )
    two = on.where("id is not null").groupBy("id").agg(
        F.collect_set(day).alias("days"), F.max_by("name", order(text("name"))).alias("title"),
        F.max_by("participants", order(some)).alias("participants"),
    )
    none = F.lit(None).cast("string")
    time = hour_and_minute(F.col("time")).alias("time")
    parts = [
        one.select(F.concat(F.lit("vadetoros:"), "id").alias("rec"), F.lit("vadetoros").alias("feed"), "days", time, "location", none.alias("title"), "participants", "breeding"),
        el.select(F.concat(F.lit("elmuletazo:"), F.col("row_id").cast("string")).alias("rec"), F.lit("elmuletazo").alias("feed"), F.array_compact(F.array(day)).alias("days"), time, "location", none.alias("title"), "participants", "breeding"),
        two.select(F.concat(F.lit("onetoro:"), "id").alias("rec"), F.lit("onetoro").alias("feed"), "days", F.lit("").alias("time"), none.alias("location"), "title", "participants", none.alias("breeding")),
    ]
    return reduce(DataFrame.unionByName, parts)


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different feeds that are the same festejo, each with its score and confidence."""
    return matches(_records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different feeds that are the same festejo."""
    return p4_matches(spark, sf_dir).select("rec_a", "rec_b").distinct()


def _breeders(text: str) -> tuple[str, int] | None:
    """A usable value's plain form and its number of names; None if it isn't usable. (So for each of the four fields.)"""
    own = [b.strip() for b in text.split(" / ")]
    return (" / ".join(map(plain, own)), len(set(map(plain, own)))) if text and all(usable(b) and breeder(b) for b in own) else None


def _people(names: tuple, other: frozenset[str] = frozenset()) -> tuple[str, int] | None:
    """``other``: plain names of places and kinds of events, which are no persons."""
    named = lambda p: usable(p) and (person(p) or (any_person(p) and not breeder(p, None) and plain(p).strip() not in other))
    return (" / ".join(sorted(map(plain, names))), len(set(map(plain, names)))) if names and all(map(named, names)) else None


def _channel(text: str) -> tuple[str, int] | None:
    return (plain(text), 1) if names_channel(text) else None


def _title(text: str) -> tuple[str, int] | None:
    return (plain(text), 1) if usable(text) else None


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable values of the duplicate groups' members: ``(group_id, field, source, value, names, at, feed, row_id)``."""
    groups, parts = table(spark, sf_dir, "dupgroups").select("group_id", "feed", "row_id").dropna().distinct(), []
    for feed in ("vadetoros", "elmuletazo", "lasventas", "canalextremadura"):
        df = table(spark, sf_dir, feed)
        at = "updatedAt" if feed == "canalextremadura" else "fetchedAt"
        title = F.col("title") if feed == "canalextremadura" else F.lit(None).cast("string")
        rows = df.select("row_id", F.lit(feed).alias("feed"), F.col(at).alias("at"), "breeding", "participants", "channel", title.alias("title"))
        parts.append(rows.join(groups.where(F.col("feed") == feed).drop("feed"), "row_id"))

    # the fixed list's labels, with their towns
    listed = table(spark, sf_dir, "refvalues").where("kind <> 'channel'").select(F.explode(F.array("label", F.regexp_extract("label", _TOWN, 1), "aka")).alias("label")).where("label <> ''")
    people = partial(_people, other=frozenset(plain(r.label).strip() for r in listed.distinct().collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for field, col, read in (("breeding", "breeding", _breeders), ("participants", "participants", people), ("channel", "channel", _channel), ("title", "title", _title)):
                # each distinct value of a batch is read once
                values = batch[col].map(lambda v: v if v is None or isinstance(v, str) else tuple(v))
                codes, distinct = pd.factorize(values)
                found = [read(v) for v in distinct]
                at = [i for i, c in enumerate(codes) if c >= 0 and found[c] is not None]
                own = batch[["group_id", "feed", "row_id", "at"]].iloc[at]
                parts.append(own.assign(field=field, value=[found[codes[i]][0] for i in at], names=[found[codes[i]][1] for i in at]))
            yield pd.concat(parts, ignore_index=True)

    schema = "group_id bigint, feed string, row_id bigint, at timestamp_ntz, field string, value string, names int"
    return reduce(DataFrame.unionByName, parts).mapInPandas(run, schema).withColumn("source", F.col("feed"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member whose value survives, for each group and field: the best supported, where most names and then the latest weigh most."""
    best = survivors(_claims(spark, sf_dir), "names", "at", ["feed", "row_id"])
    return best.select("group_id", "field", "feed", "row_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group: each field's surviving value with its support."""
    best = survivors(_claims(spark, sf_dir), "names", "at", ["feed", "row_id"])
    fields = ("breeding", "participants", "channel", "title")
    return best.groupBy("group_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields],
        *[F.max(F.when(F.col("field") == f, F.col("support"))).alias(f"{f}_support") for f in fields],
    )


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(spelling, n)``: distinct names in consistent form of the three fields, without places and kinds of events."""
    people = [
        table(spark, sf_dir, feed).select(F.explode("participants").alias("raw")) for feed in ("elmuletazo", "onetoro")
    ]
    breeders = table(spark, sf_dir, "vadetoros").select(F.col("breeding").alias("raw"))
    raw = reduce(DataFrame.unionByName, [*people, breeders]).where("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    names = (
        raw.select(F.explode(F.split(consistent_column(F.col("raw")), " / ")).alias("spelling"), "n")
        .groupBy("spelling").agg(F.sum("n").alias("n"))
    )
    # places are written "Town (Province)" or "Town, Province"; a lone value may be anything
    places = [table(spark, sf_dir, feed).select(F.regexp_extract("location", _TOWN, 1).alias("value")).distinct() for feed in ("vadetoros", "elmuletazo")]
    labels = table(spark, sf_dir, "refvalues").select(F.explode(F.array("label", F.regexp_extract("label", _TOWN, 1))).alias("value"))
    other = (
        reduce(DataFrame.unionByName, [*places, labels]).where("value is not null and value <> ''")
        .select(comparison_key(F.col("value")).alias("key")).distinct()
    )
    return names.withColumn("key", comparison_key(F.col("spelling"))).join(other, "key", "left_anti").drop("key")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different spellings of the same bullfighter or breeder."""
    return variant_pairs(_spellings(spark, sf_dir))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity and the entity's number of spellings."""
    found = entities(_spellings(spark, sf_dir))
    return found.join(found.groupBy("entity").agg(F.count("*").alias("spellings")), "entity")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part of each text goes, for each kind of container."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens and share of the space used of each kind of container."""
    bins = p8_packed(spark, sf_dir).groupBy("container_id", "capacity", "group_no", "bin_no").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy("container_id", "capacity").agg(
        F.count("*").alias("bins"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("capacity")).alias("filled"), F.max("tokens").alias("fullest"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold twelve consecutive words of an evaluation item."""
    return p9_spans(spark, sf_dir).select("item_id", "doc_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans to be removed from documents, with the item each gives away."""
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "evalitems"))


def p9_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents through an index of all words that is written once and searched for two sets of items."""
    place = f"{shared_folder(spark)}/leak-index-{uuid.uuid4().hex}"
    kept_index(table(spark, sf_dir, "documents")).write.parquet(place)
    items = table(spark, sf_dir, "evalitems")
    parts = [search_kept(spark.read.parquet(place), items.where(F.pmod(F.xxhash64("item_id"), F.lit(2)) == k)) for k in (0, 1)]
    return reduce(DataFrame.unionByName, parts).select("item_id", "doc_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document without a label of its own."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "doclabels")
    found = subjects_of(documents, labels, table(spark, sf_dir, "subjects"))
    return found.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus counted by subject: documents that are about it and sentences in them."""
    found = subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doclabels"), table(spark, sf_dir, "subjects"))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {
    "p1_found": p1_found, "p1_forms": p1_forms, "p3_found": p3_found, "p3_unmatched": p3_unmatched,
    "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_entities": p6_entities,
    "p8_packed": p8_packed, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_spans": p9_spans, "p9_kept_index": p9_kept_index, "p10_found": p10_found, "p10_composition": p10_composition,
}
