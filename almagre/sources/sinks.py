"""Sinks: documents, gated publication, overwriting without loss, and re-synchronising identified rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(RuntimeError):
    """A publication that was refused; what was published before stays."""


def write_document(df: DataFrame, path: str) -> None:
    """One JSON file of a small result."""
    df.coalesce(1).write.mode("overwrite").json(path)


def gated_write(df: DataFrame, problems: DataFrame, paths: str | list[str], partition: list[str] | None = None, allow_empty: bool = False) -> None:
    """Writes to all paths only if there are no problems (and rows); otherwise, or if a write fails, everything stays as it was.

    Each path is written beside its place first; only when all are whole do they change places, and what was there before goes last.
    """
    if not problems.isEmpty():
        raise Rejected(f"{problems.count()} problems, for example {problems.first().asDict()}")
    if not allow_empty and df.isEmpty():
        raise Rejected("nothing to publish")
    spark, mark = df.sparkSession, uuid.uuid4().hex
    files = [_File(spark, p, mark) for p in ([paths] if isinstance(paths, str) else paths)]
    try:
        for f in files:
            writer = df.write.mode("errorifexists")
            (writer.partitionBy(*partition) if partition else writer).parquet(f.new)
    except BaseException:
        for f in files:
            f.drop(f.new)
        raise
    done: list[_File] = []
    try:
        for f in files:
            done.append(f)
            f.switch()
    except BaseException:
        for f in done:
            f.back()
        raise
    for f in files:
        f.drop(f.old)


class _File:
    """A folder with a new and an old one beside it, in the file system of its path."""

    def __init__(self, spark: SparkSession, path: str, mark: str) -> None:
        self.jvm, self.path, self.new, self.old = spark.sparkContext._jvm, path.rstrip("/"), f"{path.rstrip('/')}-new-{mark}", f"{path.rstrip('/')}-old-{mark}"
        self.fs = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def move(self, source: str, target: str) -> None:
        if self.fs.exists(self.at(source)) and not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} can't become {target}")

    def switch(self) -> None:
        self.move(self.path, self.old)
        self.move(self.new, self.path)

    def back(self) -> None:
        if self.fs.exists(self.at(self.old)):
            self.drop(self.path)
            self.move(self.old, self.path)
        elif not self.fs.exists(self.at(self.new)):  # there was nothing before
            self.drop(self.path)
        self.drop(self.new)


def require_source(health: DataFrame) -> None:
    """Raises if no source could be read: ``health`` has a column ok."""
    if health.where("ok").isEmpty():
        raise Rejected("no source could be read")


def cached(df: DataFrame, path: str) -> DataFrame:
    """The table, written for the next run if it has rows; an empty one leaves what was there."""
    if not df.isEmpty():
        gated_write(df, df.limit(0), path)
    return df


def resynchronised(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, action)``: what must be cancelled, and what scheduled, to come from the old set to the new."""
    cancel = old.join(new, key, "left_anti").select(key, F.lit("cancel").alias("action"))
    schedule = new.join(old, key, "left_anti").select(key, F.lit("schedule").alias("action"))
    return cancel.unionByName(schedule)
