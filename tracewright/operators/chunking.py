"""Ordered folds: greedy chunks and budgets over the items of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_chunks(costs: Column, budget: int, most: int | None = None, base: int = 0, lone: bool = True) -> Column:
    """For an array of costs the chunk number of each; a chunk starts at `base` cost and closes
    on overflow, with an item that alone fills the budget (unless `lone` is off), or at `most` items."""
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n"), F.lit(True).alias("closed"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        c = c.cast("long")
        full = (s["n"] >= most) if most else F.lit(False)
        fresh = s["closed"] | (s["cost"] + c > budget) | full
        chunk = F.when(fresh, s["chunk"] + 1).otherwise(s["chunk"])
        cost = F.when(fresh, base + c).otherwise(s["cost"] + c)
        return F.struct(chunk.alias("chunk"), cost.alias("cost"), F.when(fresh, 1).otherwise(s["n"] + 1).alias("n"), (fresh & (base + c >= budget) & F.lit(lone)).alias("closed"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(costs, start, step, lambda s: s["out"])


def budget_prefix(costs: Column, budget: int | None) -> Column:
    """How many items stay: while the running cost fits, the first always; all without a budget."""
    if not budget:
        return F.size(costs)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("cost"), F.lit(False).alias("stop"))

    def step(s: Column, c: Column) -> Column:
        stop = s["stop"] | ((s["n"] > 0) & (s["cost"] + c > budget))
        return F.struct(F.when(stop, s["n"]).otherwise(s["n"] + 1).alias("n"), F.when(stop, s["cost"]).otherwise(s["cost"] + c).cast("long").alias("cost"), stop.alias("stop"))

    return F.aggregate(costs, start, step, lambda s: s["n"])


def batches(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batches of a fixed size in order."""
    from pyspark.sql import Window

    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))
