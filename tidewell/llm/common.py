"""What the operators of this folder share: shared-folder tables and helpers for row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one array of ``repeat_rows`` may hold.
REPEAT_BLOCK = 4096
#: Rows and bytes of texts that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to the session's Python workers in batches of no more than these rows and bytes.

    The settings hold for the session, as they are read only when a query runs; smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is unset and all tasks
    run in this process, as in local tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    return Scratch(df.sparkSession).keep(df, what)


class Scratch:
    """An operator's tables in the shared folder; each goes as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = fresh_path(self.spark, what)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is t for t in tables):
                remove(self.spark, path)
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in tables)]

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, _ in self.tables if not any(t is x for x in tables)))


def text_key(col) -> F.Column:
    """16 bytes that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(col, F.lit(""))))


def repeat_rows(df: DataFrame, times: str, ordinal: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``ordinal``.

    Two levels keep every array small, whatever the count.
    """
    blocks = df.withColumn("__block", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {REPEAT_BLOCK})")))
    left = F.expr(f"least({REPEAT_BLOCK}L, {times} - __block * {REPEAT_BLOCK}L)")
    return (
        blocks.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), left)))
        .withColumn(ordinal, F.expr(f"__block * {REPEAT_BLOCK}L + __n"))
        .drop("__block", "__n")
    )


def whole(docs: DataFrame, **more: F.Column) -> DataFrame:
    """Each row as one struct, ``row``, so that columns of any name meet no others; and the columns ``more``."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in more.items()))


def named(docs: DataFrame, name: str) -> F.Column:
    """A column by its plain name, dots included."""
    return F.col(f"`{name}`")


def keep_rows(docs: DataFrame, decisions: DataFrame, key: F.Column) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, key, times) keeps, each once.

    ``key`` is the text key of a row of ``docs``.  Rows that repeat a kept ``doc_id`` and key are
    reduced to one; only those rows pass through the extra aggregation.
    """
    tagged = whole(docs, id=F.col("doc_id").cast("long"), text_key=key)
    found = tagged.join(decisions, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")), "inner")
    single = found.where("times = 1").select("row.*")
    several = found.where("times > 1").dropDuplicates(["id", "text_key"]).select("row.*")
    return single.union(several)
