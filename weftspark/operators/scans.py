"""Scans over long sequences in blocks, and ranges met by the points inside them.

Nothing here sorts or sums a whole sequence in one task: rows are cut into
blocks of `stride` places, blocks are summed up, blocks of blocks after them,
and carries come back down. Ranges are cut at the same borders, so a range over
a billion places is a row per block and never a list of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a block.
STRIDE = 1 << 16


def segmented_sums(df: DataFrame, order: str, parts: dict[str, tuple[Column, Column]], keys: list[str] | None = None, stride: int = STRIDE, levels: int = 3) -> DataFrame:
    """df with a column for each of `parts` (name: (reset, value)): the sum of the values before a row, since the last row that resets, that one's value included.

    order holds whole numbers, different ones for the rows of a key; without
    keys all rows are one sequence. The sums are a scan over pairs (reset,
    value), of which (a, x) and (b, y) make (a or b, y if b else x + y).
    """
    keys = keys or []
    block = [*keys, "_block"] if levels else keys or [F.lit(0)]
    before = Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_block", F.floor(F.col(order) / stride)) if levels else df
    for name, (reset, value) in parts.items():
        rows = rows.withColumns({f"_r_{name}": F.coalesce(reset, F.lit(False)), f"_v_{name}": F.coalesce(value, F.lit(0)).cast("bigint")})
    rows = rows.withColumns({f"_s_{name}": F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)) for name in parts})
    rows = rows.withColumns({f"_l_{name}": F.last(F.when(F.col(f"_r_{name}"), F.col(f"_s_{name}")), ignorenulls=True).over(before) for name in parts})
    own = {name: F.col(f"_s_{name}") - F.coalesce(f"_l_{name}", F.lit(0)) for name in parts}
    spare = [f"_{c}_{name}" for name in parts for c in "rvsl"]
    if not levels:
        return rows.withColumns(own).drop(*spare)
    sums = []
    for name in parts:
        last = F.max_by(F.when(F.col(f"_r_{name}"), F.col(f"_s_{name}")), F.when(F.col(f"_r_{name}"), F.col(order)))
        sums += [F.max(f"_r_{name}").alias(f"_a_{name}"), (F.sum(f"_v_{name}") - F.coalesce(last, F.lit(0))).alias(f"_t_{name}")]
    blocks = rows.groupBy(*block).agg(*sums).withColumnRenamed("_block", "_o")
    carried = segmented_sums(blocks, "_o", {f"_c_{name}": (F.col(f"_a_{name}"), F.col(f"_t_{name}")) for name in parts}, keys, stride, levels - 1)
    carried = carried.select(*keys, F.col("_o").alias("_block"), *[f"_c_{name}" for name in parts])
    out = {name: own[name] + F.when(F.col(f"_l_{name}").isNull(), F.col(f"_c_{name}")).otherwise(0) for name in parts}
    return rows.join(carried, block).withColumns(out).drop("_block", *spare, *[f"_c_{name}" for name in parts])


def with_owner(points: DataFrame, ranges: DataFrame, place: str, owner: str, stride: int = STRIDE, beside: DataFrame | None = None, tasks: int = 0) -> DataFrame:
    """points with the owner of the range that holds their place; points in none go.

    ranges (owner, start, stop) hold the places start to stop - 1 and don't
    overlap; empty ones are allowed. Points and pieces of ranges meet in blocks
    of `stride` places, by one sort inside a block.

    beside (place, value), of different places: joined to the points, which then
    have different places too, in that same sort; a point without a value goes.
    tasks: over so many the blocks are dealt out, where the caller knows the number
    of points; else over the session's shuffle partitions.
    """
    pieces = ranges.where("start < stop").select(owner, "start", "stop", F.explode(F.sequence(F.expr(f"start div {stride}"), F.expr(f"(stop - 1) div {stride}"))).alias("_block"))
    pieces = pieces.select("_block", F.greatest(F.col("start"), F.col("_block") * stride).alias("_at"), F.struct(F.col(owner).alias("o"), F.col("stop").alias("e")).alias("_range"))
    block, at = F.expr(f"`{place}` div {stride}").alias("_block"), F.col(place).cast("bigint").alias("_at")
    rows = points.select(block, at, F.struct("*").alias("_point"))
    both = pieces.unionByName(rows, allowMissingColumns=True)
    if beside is not None:
        (name,) = [c for c in beside.columns if c != place]
        both = both.unionByName(beside.select(block, at, F.struct(name).alias("_beside")), allowMissingColumns=True)
    if tasks:
        both = both.repartition(tasks, "_block")
    # a piece comes before the points at its first place, a point before the value there
    order = Window.partitionBy("_block").orderBy("_at", *([F.col("_beside").isNotNull()] if beside is not None else []), F.col("_point").isNotNull())
    met = both.withColumn("_in", F.last("_range", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if beside is None:
        return met.where("_point IS NOT NULL AND _at < _in.e").select("_point.*", F.col("_in.o").alias(owner))
    met = met.withColumns({"_next": F.lead("_at").over(order), "_value": F.lead("_beside").over(order)})
    met = met.where("_point IS NOT NULL AND _at < _in.e AND _next = _at AND _value IS NOT NULL")
    return met.select("_point.*", F.col(f"_value.{name}").alias(name), F.col("_in.o").alias(owner))


def places(ranges: DataFrame, owner: str, name: str, stride: int = STRIDE) -> DataFrame:
    """(owner, name): a row per place of each range (owner, start, stop); long ranges are cut before they are spread, so no row makes more than `stride`."""
    pieces = ranges.where("start < stop").select(owner, "start", "stop", F.explode(F.sequence(F.expr(f"start div {stride}"), F.expr(f"(stop - 1) div {stride}"))).alias("_block"))
    cut = pieces.select(owner, F.greatest("start", F.col("_block") * stride).alias("_a"), F.least("stop", (F.col("_block") + 1) * stride).alias("_b"), "_block")
    # pieces of one long range go to different tasks
    return cut.repartition(owner, "_block").select(owner, F.explode(F.sequence("_a", F.col("_b") - 1)).alias(name))
