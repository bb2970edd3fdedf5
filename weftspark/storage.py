"""Tables in the shared folder, to cut lineage between jobs of an iteration."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and is below this many bytes.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df and reads it back."""
    path = f"{shared_folder(df.sparkSession)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


#: Bytes of input in a shuffle partition, by Spark's own estimate, from which the session's number of them is kept.
PARTITION_BYTES = 64 << 20


@contextmanager
def partitions_for(df: DataFrame, number: int = 0) -> Iterator[int]:
    """Inside, a job over df has no more shuffle partitions than its size asks for, or than run at once.

    Bucketed tables can't be coalesced as shuffles are, so a small graph would
    otherwise pay for the session's whole number of partitions in each round.
    The number is only ever lowered; an input of unknown size keeps it. With
    `number`, that many.
    """
    spark, key = df.sparkSession, "spark.sql.shuffle.partitions"
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    have = spark.conf.get(key)
    number = number or min(int(have), max(spark.sparkContext.defaultParallelism, math.ceil(size / PARTITION_BYTES)))
    spark.conf.set(key, str(number))
    try:
        yield number
    finally:
        spark.conf.set(key, have)


def buckets(spark: SparkSession) -> int:
    """Buckets of a bucketed table: as many as shuffle partitions, so that a shuffled side meets it without another exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save_bucketed(df: DataFrame, by: list[str], name: str = "table", dealt: bool = False, **seen: Column) -> DataFrame:
    """Writes df as a table bucketed by columns: joins and aggregations on them read it where it lies.

    dealt: the rows come out of a join or an aggregation on `by`, so they lie
    right and are written as they are. seen: aggregates that are taken while
    writing, by name in the result's _weft_seen; no job of their own is needed.
    """
    spark = df.sparkSession
    label = f"weft_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/weft/{label}"
    count = Observation(label) if seen else None
    if count:
        df = df.observe(count, *[c.alias(k) for k, c in seen.items()])
    if not dealt:
        df = df.repartition(buckets(spark), *by)
    df.write.format("parquet").bucketBy(buckets(spark), *by).option("path", path).saveAsTable(label)
    out = spark.table(label)
    out._weft_path, out._weft_table, out._weft_seen = path, label, count.get if count else {}
    return out


def drop(*tables: DataFrame) -> None:
    """Removes saved tables that nothing reads any more; others are left alone."""
    for df in tables:
        if label := getattr(df, "_weft_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {label}")
        if where := getattr(df, "_weft_path", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if its counted size allows it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
