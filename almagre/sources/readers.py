"""Scans: envelopes of JSON events, optional and isolated sources, text, XML and landed pages."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of the feeds' envelopes and events.
EVENT = (
    "id STRING, source STRING, date STRING, time STRING, channel STRING, deferred BOOLEAN, televised BOOLEAN, "
    "televisionUnconfirmed BOOLEAN, location STRING, name STRING, title STRING, type STRING, contentType STRING, "
    "breeding STRING, participants ARRAY<STRING>, description STRING, slug STRING, image STRING, published BOOLEAN, "
    "live BOOLEAN, eventUrl STRING, sourceUrl STRING, sourceText STRING"
)
ENVELOPE = f"source STRING, sourceUrl STRING, fetchedAt STRING, updatedAt STRING, generatedAt STRING, eventCount INT, events ARRAY<STRUCT<{EVENT.replace(' STRING', ':STRING').replace(' BOOLEAN', ':BOOLEAN').replace(' ARRAY', ':ARRAY')}>>"


def json_documents(spark: SparkSession, path: str, schema: str = ENVELOPE, strict: bool = False) -> DataFrame:
    """Whole-file JSON documents with their file; broken ones fail (strict) or come with nulls and ``corrupt``."""
    reader = spark.read.option("multiLine", True)
    if strict:
        return reader.option("mode", "FAILFAST").schema(schema).json(path).withColumn("file", F.col("_metadata.file_name"))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return reader.schema(f"{schema}, corrupt STRING").json(path).withColumn("file", F.col("_metadata.file_name"))


def events_of(documents: DataFrame) -> DataFrame:
    """A row per event with its position, the envelope's source and time of delivery; an absent list is empty."""
    at = F.coalesce("fetchedAt", "updatedAt")
    return documents.select(
        "file", F.col("source").alias("feed"), at.alias("fetched_at"), F.posexplode("events").alias("position", "event")
    ).select("file", "feed", "fetched_at", "position", "event.*")


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """A scan of a path that may not exist: then an empty table of the schema."""
    try:
        return spark.read.format(fmt).schema(schema).option("multiLine", True).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def isolated(spark: SparkSession, sources: dict[str, str], schema: str = ENVELOPE) -> tuple[DataFrame, DataFrame]:
    """The documents of all sources, and ``(source, ok, events, fetched_at, error)`` of each: one that is missing or broken doesn't stop the rest.

    A source is ok if it is there and none of its files is broken; a broken file is a document of nulls (``corrupt`` holds its text) and has no events. ``events`` that aren't a list are none.
    """
    parts, health = [], []
    for name, path in sources.items():
        try:
            parts.append(json_documents(spark, path, schema).withColumn("source_key", F.lit(name)))
        except AnalysisException as error:
            health.append((name, False, 0, None, str(error).split("\n")[0][:200]))
    empty = spark.createDataFrame([], f"{schema}, corrupt STRING, file STRING, source_key STRING")
    documents = reduce(DataFrame.unionByName, parts, empty)
    broken = F.max(F.when(F.col("corrupt").isNotNull(), F.concat(F.lit("broken: "), "file")))
    read = documents.groupBy(F.col("source_key").alias("source")).agg(
        broken.isNull().alias("ok"), F.sum(F.coalesce(F.size("events"), F.lit(0))).alias("events"), F.max(F.coalesce("fetchedAt", "updatedAt")).alias("fetched_at"), broken.alias("error")
    )
    # one row a source
    rows = [(r["source"], r["ok"], r["events"], r["fetched_at"], r["error"]) for r in read.collect()]
    return documents, spark.createDataFrame(rows + health, "source STRING, ok BOOLEAN, events BIGINT, fetched_at STRING, error STRING")


def all_sources(parts: dict[str, DataFrame], at: tuple = ("fetchedAt", "updatedAt")) -> DataFrame:
    """Tables of any schema as one, by column names, with ``feed`` and ``at``: the first of the columns of delivery a table has; missing columns are null."""
    out = [df.withColumns({"feed": F.lit(name), "at": F.coalesce(*[F.col(c) for c in at if c in df.columns], F.lit(None))}) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def first_filled(*frames: DataFrame) -> DataFrame:
    """The first table that has rows (network, cache, bundled); an empty answer counts as a failure."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary table, or the fallback where the primary is empty, decided when it runs."""
    there = primary.select(F.lit(1).alias("x_")).limit(1)
    return primary.unionByName(fallback.join(there, how="left_anti"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag of XML files."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)`` of landed pages."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
