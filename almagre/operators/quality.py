"""Quality reports: violations as rows, volumes against the previous delivery, source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``(key, violation)``: a row for each check a row fails; a check that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(F.col(key), F.explode(failed).alias("violation"))


def shrunk(counts: DataFrame, group: list[str], order: str, least: int, share: float) -> DataFrame:
    """Deliveries ``(…, n)`` with less than a share of the one before, where that had at least so many rows."""
    from pyspark.sql import Window

    before = F.lag("n").over(Window.partitionBy(*group).orderBy(order))
    return counts.withColumn("before", before).where((F.col("before") >= least) & (F.col("n") < F.floor(F.col("before") * share)))


def source_health(df: DataFrame, source: str, fetched: str, sources: list[str]) -> DataFrame:
    """``(source, n, latest, status)`` for each expected source, whether it delivered or not."""
    spark = df.sparkSession
    known = spark.createDataFrame([(s,) for s in sources], f"{source} string")
    counts = df.groupBy(source).agg(F.count("*").alias("n"), F.max(fetched).alias("latest"))
    return known.join(counts, source, "left").select(
        source, F.coalesce("n", F.lit(0)).alias("n"), "latest", F.when(F.col("n").isNull(), "missing").otherwise("ok").alias("status")
    )
