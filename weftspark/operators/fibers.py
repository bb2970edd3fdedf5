"""A scan along fibers as a table function for SQL.

    SELECT * FROM fiber_scan(TABLE(t) PARTITION BY (m) ORDER BY (n), 'v', 100)

Spark deals the fibers out and sorts them; the function sees a fiber's entries
in order and leaves off as soon as their sum has reached what is asked for, so
the rest of a fiber is skipped. Rows that are skipped still travel to Python one
by one; where fibers are much longer than what is asked for, needed() leaves
them out before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException


class FiberScan:
    """Entries of a fiber with their place in it and the sum up to and with them, until the sum is `enough`."""

    def __init__(self):
        self.place = self.total = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, value: AnalyzeArgument, enough: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("fiber_scan needs a TABLE argument, partitioned by the outer and ordered by the inner coordinates")
        if value.value not in table.dataType.names:
            raise ValueError(f"the table has no column {value.value}")
        return AnalyzeResult(StructType([*table.dataType.fields, StructField("place", IntegerType()), StructField("total", LongType())]))

    def eval(self, row: Row, value: str, enough: int):
        self.total += row[value] or 0
        yield (*row, self.place, self.total)
        self.place += 1
        if self.total >= enough:
            raise SkipRestOfInputTableException

    def terminate(self):
        yield from ()


def register(spark: SparkSession, name: str = "fiber_scan") -> None:
    """Makes the function known to a session's SQL."""
    spark.udtf.register(name, udtf(FiberScan))


def needed(df: DataFrame, outer: list[str], inner: list[str], value: str, enough: int) -> DataFrame:
    """The rows of df that a scan sees before it leaves off: those of a fiber before which no sum has reached `enough`. No two rows of a fiber are at the same place."""
    fiber = Window.partitionBy(*outer).orderBy(*inner)
    upto = df.withColumn("_total", F.sum(F.coalesce(F.col(value), F.lit(0)).cast("bigint")).over(fiber.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.max("_total").over(fiber.rowsBetween(Window.unboundedPreceding, -1))
    return upto.withColumn("_most", most).where(F.col("_most").isNull() | (F.col("_most") < enough)).select(*df.columns)
