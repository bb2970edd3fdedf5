"""Tensors, graphs and traces derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.model import Graph, Tensor

#: Lines that a task adds up to entries of a matrix, about.
LINES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_matrix(spark: SparkSession, sf_dir: str, index: tuple[str, str] = ("m", "k")) -> Tensor:
    """Embeddings as whole numbers, thousandths rounded: (vec_id, place)."""
    e = table(spark, sf_dir, "embeddings")
    size = e.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    df = e.select(F.col("vec_id").cast("int").alias(index[0]), F.posexplode("embedding").alias(index[1], "x"))
    return Tensor(df.select(*index, F.floor(F.col("x").cast("double") * 1000 + 0.5).cast("bigint").alias("v")), index, (int(size[0]), int(size[1])))


def event_vector(spark: SparkSession, sf_dir: str, index: str = "i") -> Tensor:
    """Whole parts of the events' values by event_id."""
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id") + 1).first()[0]
    return Tensor(e.select(F.col("event_id").cast("int").alias(index), F.floor("value").cast("bigint").alias("v")), (index,), (int(n),))


def supply_matrix(spark: SparkSession, sf_dir: str) -> Tensor:
    """Quantities by supplier and part: a sparse matrix."""
    x = table(spark, sf_dir, "lineitem")
    size = x.agg(F.max("l_suppkey") + 1, F.max("l_partkey") + 1, F.count(F.lit(1))).first()
    # most lines are an entry of their own, so they are dealt out by their number before they are added up
    lines = x.select(F.col("l_suppkey").cast("int").alias("m"), F.col("l_partkey").cast("int").alias("n"), F.col("l_quantity").cast("bigint").alias("_q"))
    df = lines.repartition(-(-size[2] // LINES) or 1, "m", "n").groupBy("m", "n").agg(F.sum("_q").alias("v"))
    return Tensor(df, ("m", "n"), (int(size[0]), int(size[1])))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A weighted directed graph over customers: an edge from each order's customer to another, lightest of parallel ones."""
    n = int(table(spark, sf_dir, "customer").count())
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("s"), ((F.col("o_orderkey") * 7 + 3) % n).cast("int").alias("d"), (F.col("o_orderkey") % 16 + 1).cast("bigint").alias("w"))
    return Graph(o.groupBy("s", "d").agg(F.min("w").alias("w")), n)


def event_trace(spark: SparkSession, sf_dir: str, partitions: int = 4) -> DataFrame:
    """Events as a memory trace: users are addresses, one event type is updates, requestors take turns."""
    e = table(spark, sf_dir, "events")
    update = e.agg(F.min("event_type")).first()[0]
    return e.select(F.lit("events").alias("tensor"), F.lit(0).alias("port"), F.lit(0).alias("level"), (F.col("event_id") % partitions).cast("int").alias("buffer"), F.col("event_id").cast("bigint").alias("seq"), F.col("user_id").cast("bigint").alias("addr"), (F.col("event_id") % partitions).cast("int").alias("requestor"), F.when(F.col("event_type") == update, "U").otherwise("R").alias("kind"))


