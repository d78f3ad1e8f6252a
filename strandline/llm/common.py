"""Shared plumbing: tables, cut lineage, size estimates."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session may go without; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(columns: list[str], name: str) -> str:
    """The name, or the name with as many underscores after it as it takes to be no column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store; nothing may read it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 12 << 20


def bounded_batches(df: DataFrame) -> None:
    """Has Spark hand Python at most 12 MB at a time (64 MB is its default), in JVM and worker alike."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of these text columns over all rows, measured in one job: compressed sizes say little."""
    each = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns]
    return int(df.agg(F.sum(sum(each[1:], each[0]))).first()[0] or 0)


#: More tasks than this gain nothing; beyond it a task takes several buckets, one after the other.
MOST_TASKS = 20_000


def buckets_for(df: DataFrame, size: float, target: int = 16 << 20) -> int:
    """Buckets of about ``target`` bytes for so many in all, as many as it takes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / target))


def by_key(df: DataFrame, buckets: int, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows out by key, sorted by key within each task."""
    return df.repartition(min(buckets, MOST_TASKS), *keys).sortWithinPartitions(*keys, *order)


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % parts == part
