"""Two-pass external shuffle into shards of equal row counts, with DataFrame functions only.

Pass one scatters records into memory-sized buckets by a seeded hash; pass two
shuffles each bucket (Spark's shuffle() is a seeded Fisher-Yates shuffle) and
writes it. The buckets in order are one random order of all records; shard s
of n holds the s-th n-th part of it, so counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm import common

#: A bucket holds about so many bytes of text or rows, whichever is reached first.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 1 << 16
#: Buckets in a task of the second pass, about.
BUCKETS_A_TASK = 2
#: Buckets whose offsets one task sums up.
STRIDE = 4096


def scatter_and_shuffle(docs: DataFrame, seed: int, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, i, rec) after both passes: i is the place of the record in its shuffled bucket.

    Each task of the second pass gets BUCKETS_A_TASK consecutive buckets.
    """
    rec = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # the row's place in its file goes into the hash, so that equal or null ids spread like any others
    rows = docs.select(rec.alias("rec"), F.monotonically_increasing_id().alias("uid")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(f"rec.`{id_col}`"), "uid"), F.lit(buckets)).cast("int"))
    tasks = rows.withColumn("task", (F.col("bucket") / BUCKETS_A_TASK).cast("int"))
    scattered = tasks.repartitionById(max(1, math.ceil(buckets / BUCKETS_A_TASK)), "task")
    packed = scattered.groupBy("task", "bucket").agg(F.sort_array(F.collect_list(F.struct("uid", "rec"))).alias("rows"))
    # buckets in order and rows sorted: shuffle() draws the same numbers in every attempt of a task
    return packed.sortWithinPartitions("bucket").withColumn("rows", F.shuffle("rows", F.lit(seed))).select("bucket", F.posexplode("rows").alias("i", "r")).select("bucket", "i", "r.rec")


def shard(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with shard (0 to shards - 1) and slot (from 0, without gaps).

    An input column named shard or slot is replaced. Rows with null or repeated
    ids and null texts are rows like any other; an empty table stays empty.
    Places follow from the seed, the ids and the rows' places in their files:
    docs should be a stored table, whose splits come in the same order again
    when a task is repeated.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias("b")).first()
    buckets = max(1, math.ceil((total.b or 0) / BUCKET_BYTES), math.ceil(total.n / BUCKET_ROWS))
    written = common.save(scatter_and_shuffle(docs, seed, id_col, text_col, buckets), "shuffled")
    # a row per bucket: running sums inside strides of buckets, then over the strides
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("stride", (F.col("bucket") / STRIDE).cast("int"))
    strides = counts.groupBy("stride").agg(F.sum("n").alias("m"))
    base = strides.select("stride", F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = counts.select("stride", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("stride").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    starts = inside.join(base, "stride").select("bucket", (F.col("base") + F.col("inner")).alias("start"))
    if buckets * 32 <= common.BROADCAST_BYTES:
        starts = F.broadcast(starts)
    placed = written.join(starts, "bucket").withColumn("pos", F.col("start") + F.col("i")).withColumn("shard", F.expr(f"int(pos * {shards} div {max(1, total.n)})"))
    return placed.withColumn("slot", F.expr(f"pos - (shard * {total.n}L + {shards - 1}) div {shards}")).select("rec.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """Writes one folder per shard, its rows in slot order over files of bounded size."""
    sharded.repartitionByRange(4 * shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
