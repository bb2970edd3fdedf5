"""Statistics text files: parsing, roll-up, and comparison with a baseline schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.operators import scans


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, depth, name, n) from indented `name:` headers and `counter: value` lines; n is null for a header."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    parts = rows.withColumn("name", F.trim(F.regexp_extract("text", r"^\s*([^:]+):", 1))).withColumn("n", F.regexp_extract("text", r":\s*(-?[0-9]+)\s*$", 1).try_cast("bigint"))
    return parts.where("name <> ''").select("file", "line", F.length(F.regexp_extract("text", r"^(\s*)", 1)).alias("depth"), "name", "n")


def write_counters(counters: DataFrame, path: str, header: str, name: str, value: str) -> None:
    """Counters as text that read_counters() reads: a file of a header and its indented lines for each value of the header column.

    Each header's text is put together in one task: a component has a few counters.
    """
    lines = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("  "), F.col(name).cast("string"), F.lit(": "), F.col(value).cast("string")))), "\n")
    text = counters.groupBy(header).agg(lines.alias("_lines")).select(F.concat(F.col(header).cast("string"), F.lit(":\n"), "_lines").alias("value"))
    text.write.text(path)


def with_header(counters: DataFrame) -> DataFrame:
    """Counter lines with the name of the header they stand under (a file's lines are few and of one task)."""
    over = Window.partitionBy("file").orderBy("line")
    return counters.withColumn("header", F.last(F.when(F.col("n").isNull(), F.col("name")), ignorenulls=True).over(over)).where("n IS NOT NULL")


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    """(graph, schedule, a_total, a_offchip, b_total, b_offchip): graph name lines, each followed by rows of four numbers; rows of zeros mean "not run" and go."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    numbers = F.split(F.trim("text"), r"[\s,]+")
    # a line of numbers belongs to the name line before it: names are counted in stretches of lines
    marked = scans.segmented_sums(rows.withColumn("_x", F.when(F.size(numbers) >= 4, numbers)), "line", {"_g": (F.lit(False), F.col("_x").isNull().cast("bigint"))}, levels=1)
    names = marked.where("_x IS NULL").select((F.col("_g") + 1).alias("_g"), F.trim("text").alias("graph"))
    kept = marked.where("_x IS NOT NULL").join(names, "_g", "left")
    placed = kept.withColumn("schedule", F.row_number().over(Window.partitionBy("graph").orderBy("line")) - 1)
    cols = [F.try_element_at("_x", F.lit(i + 1)).cast("double").cast("bigint").alias(c) for i, c in enumerate(("a_total", "a_offchip", "b_total", "b_offchip"))]
    out = placed.select("graph", "schedule", *cols)
    return out.where("a_total + a_offchip + b_total + b_offchip > 0")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def normalised(stats: DataFrame, keys: list[str], schedule: str, value: str, baseline) -> DataFrame:
    """stats with the value's ratio to the baseline schedule of the same keys."""
    base = stats.where(F.col(schedule) == baseline).select(*keys, F.col(value).alias("_base"))
    return stats.join(base, keys, "left").withColumn("ratio", ratio(F.col(value), F.coalesce("_base", F.lit(0)))).drop("_base")
