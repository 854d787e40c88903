"""Arrivals against a store of what was seen: each key once, over all batches of a stream, whatever is run again.

The store lies in one folder: ``nuevo/lote=N`` holds the keys that batch N brought, ``base/lote=N`` those of all batches
before N.  Batch N looks at batches before it alone and overwrites what an earlier attempt at it left, so a batch that is
run again, wherever it broke off, gives the same rows and the same store.  No list of versions is needed: a stream begins
a batch only when the one before is done, and bases come every ``fold`` batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import newest_per_group


@dataclass(frozen=True)
class SeenStore:
    """``group``: the column of the outlet; ``key``: what names a row within it; ``most``: keys kept for each outlet, the
    last by key (None: all)."""

    folder: str
    group: str
    key: str
    schema: str
    most: int | None = 20000
    fold: int = 16

    def read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def bounded(self, keys: DataFrame) -> DataFrame:
        return keys if self.most is None else newest_per_group(keys, self.group, [F.desc(self.key)], self.most)

    def path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/lote={batch}"

    def parts(self, spark: SparkSession, base: int, batch: int) -> DataFrame:
        """The base, and what came from then on and before ``batch``."""
        return self.read(spark, ([self.path("base", base)] if base else []) + [self.path("nuevo", n) for n in range(base, batch)])

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The keys that are known when a batch begins."""
        base = batch - batch % self.fold
        if base and base == batch:  # the first to need this base makes it
            self.bounded(self.parts(spark, base - self.fold, base)).write.mode("overwrite").parquet(self.path("base", base))
            for n in range(max(base - 2 * self.fold, 0), base - self.fold):
                self.remove(spark, self.path("nuevo", n))
            if base > 2 * self.fold:
                self.remove(spark, self.path("base", base - 2 * self.fold))
        return self.bounded(self.parts(spark, base, batch))

    def remove(self, spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def save(self, batch: int, keys: DataFrame) -> None:
        keys.write.mode("overwrite").parquet(self.path("nuevo", batch))


def unseen(rows: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key that is not known; rows without a key are all kept, as nothing tells them apart.

    The known keys are cut to those of the batch first: where the batch's keys are small enough, Spark sends them to
    the store's files and nothing of the store is shuffled.
    """
    whole = F.forall(F.array(*(F.col(k).cast("string") for k in keys)), lambda x: x.isNotNull() & (x != ""))
    first = rows.where(whole).groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("row"))
    met = known.join(first.select(*keys), keys, "left_semi")
    return first.join(met, keys, "left_anti").select("row.*").unionByName(rows.where(~whole))


def arrive(batch: DataFrame, number: int, store: SeenStore, out: str, order: list[str]) -> None:
    """One batch: its unseen rows to ``out/lote=number``, their keys to the store."""
    spark, keys = batch.sparkSession, [store.group, store.key]
    at = f"{out}/lote={number}"
    unseen(batch, store.before(spark, number), keys, order).write.mode("overwrite").parquet(at)
    # the keys come from what was written, so both are of one attempt
    there = spark.read.schema(batch.schema).parquet(at).select(*keys)
    store.save(number, there.where(" AND ".join(f"coalesce(`{k}` <> '', false)" for k in keys)))


def arrivals(stream: DataFrame, store: SeenStore, out: str, checkpoint: str, order: list[str], write: Callable = arrive) -> None:
    """Run a stream over all that has come; files in ``out``, a folder for each batch."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: write(batch, number, store, out, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
