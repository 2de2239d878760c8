"""Streams of feed deliveries: folding snapshots into a retained table, windowed counts with late data, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almagre.operators.dedupe import keep_last
from almagre.sources.sinks import resynchronised


def deliveries(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1, only: str = "*") -> DataFrame:
    """A stream of the parquet files that arrive in a folder, by their names' pattern."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", only).parquet(path)


def fold_latest(stream: DataFrame, key: list[str], version: str, path: str, checkpoint: str):
    """Keeps the latest row of each key in a table: each batch is merged with the table and written beside it.

    Tables are written under a number that rises with the batch, so a repeated batch gives the same table; of the older ones only
    the one before is kept, from which a repeated batch starts again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        keep_last(rows.withColumn("v_", F.unix_micros(F.col(version).cast("timestamp"))), key, "v_").drop("v_").write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, time: str, group: str, value: str, window: str, slide: str | None, late: str) -> DataFrame:
    """Counts and sums of sliding windows; rows later than the watermark are left out."""
    own = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        stream.withWatermark(time, late).groupBy(own.alias("w"), group)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "total")
    )


def sessions(stream: DataFrame, time: str, user: str, gap: str, late: str) -> DataFrame:
    """Sessions of a user: rows not further apart than a gap."""
    return (
        stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")
    )


def changes(stream: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before, after)`` whenever a key's value changes; the state of a key is its last value."""

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for batch in batches:
            for v in batch[value]:
                if v != last:
                    rows.append((own[0], last, v))
                    last = v
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, "before", "after"])

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} string, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout
    )


def timely(stream: DataFrame, date: str, as_of: str, before: int = 7, after: int = 180) -> DataFrame:
    """Rows whose own date lies around ``as_of``; unlike a watermark this doesn't depend on what came before."""
    day = F.try_to_date(F.col(date), "yyyy-MM-dd")
    return stream.where(day.between(F.date_sub(F.lit(as_of).cast("date"), before), F.date_add(F.lit(as_of).cast("date"), after)))


def refreshed(stream: DataFrame, act, checkpoint: str, seconds: int = 30):
    """Calls ``act(batch, number)`` with what has come every so many seconds."""
    return stream.writeStream.foreachBatch(act).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint)


def resynchronising(stream: DataFrame, key: str, path: str, checkpoint: str):
    """Each batch is a whole set of identifiers: writes ``(key, action)`` to ``path/actions/<batch>``, from the set before to this one.

    The sets stand under ``path/sets/<batch>``; a repeated batch compares with the same set and writes the same actions.
    """

    def act(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key).distinct()
        new.write.mode("overwrite").parquet(f"{path}/sets/{number}")
        now = spark.read.parquet(f"{path}/sets/{number}")
        before = spark.read.parquet(f"{path}/sets/{number - 1}") if number else now.limit(0)
        resynchronised(before, now, key).write.mode("overwrite").parquet(f"{path}/actions/{number}")

    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
