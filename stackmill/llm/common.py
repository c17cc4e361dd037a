"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a text, as the operators split words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode
    (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="stackmill-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base


#: Rows of an Arrow batch in jobs that this library starts itself: texts may be long, and a batch is held whole.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside exchange batches of BATCH_ROWS rows with Python, whatever the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, forgets partitioning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stackmill/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder, for small frames."""
    shared_dir(df.sparkSession)
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def set_apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose columns other than the needed ones have generated names, so that no name an operator adds clashes with
    them, and the function that gives the columns of docs back, in their order."""
    names = [c if c in needed else f"_given_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(col: Column) -> Column:
    """Maximal runs of characters other than space and \\t to \\r; null gives no words."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE), lambda w: w != "")


def partitions_for(spark: SparkSession, amount: float, per_partition: float) -> int:
    """Partitions so that each holds about per_partition, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount / per_partition) + 1)


def crc_fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, the same ones for the same keys: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(key), key).limit(n)
