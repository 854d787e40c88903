"""Structured Streaming forms of the time-driven steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of a table's files, which may be one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name}.parquet*")


def seen_once(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Counts per key and day, updated as rows arrive."""
    return stream.groupBy(F.window(ts, "1 day").alias("dia"), key).agg(F.count(F.lit(1)).alias("total")).select(key, F.col("dia.start").alias("dia"), "total")


def late_policy(batch: DataFrame, ts: str, now, grace_minutes: int) -> DataFrame:
    """``resultado``: firings later than the grace are left out, never made up for."""
    late = F.lit(now).cast("timestamp") - F.col(ts) > F.expr(f"INTERVAL {int(grace_minutes)} MINUTES")
    return batch.withColumn("resultado", F.when(late, "omitida").otherwise("iniciada"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there and stop; files at ``path``, one folder per batch in complete mode."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
