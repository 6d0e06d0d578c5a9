"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_PER_BATCH = "512"


def prepare(spark: SparkSession) -> None:
    """Batches small enough for very long texts, and a shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS_PER_BATCH)
    shared_folder(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one is set only where there is none, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sylvan-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is not made."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, read from the shared folder: lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder; columns are pruned when it is read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def buckets(spark: SparkSession, factor: int = 2) -> int:
    """How many buckets a shuffle of packed rows uses, from the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


def buckets_for(rows: DataFrame, column: str, size: int, factor: int = 1) -> int:
    """As many buckets as ``buckets``, or one for each ``size`` bytes of a column if those are more."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(buckets(rows.sparkSession, factor), -(-total // size))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))
