"""Counts over a stream of edges (s, d), kept up as edges come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def degrees(stream: DataFrame) -> DataFrame:
    """(v, out_deg, in_deg): one aggregation over both ends of each edge."""
    ends = stream.select(F.explode(F.array(F.struct(F.col("s").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("d").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.sum("o").cast("bigint").alias("out_deg"), F.sum("i").cast("bigint").alias("in_deg"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Edges per window of event time and key; what comes later than `late` goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def drain(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what a source has now through a streaming query and returns its result table."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def drain_to(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what a source has now through a streaming query; each batch's result table replaces the one before in the shared folder."""
    written = []

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{number}")
        written.append(number)

    query = result.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return result.sparkSession.createDataFrame([], result.schema)
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/{written[-1]}")
