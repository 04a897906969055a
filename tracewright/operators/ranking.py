"""Top-k, ranks and selections inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forced_top(df: DataFrame, group: Sequence[str], forced: str, input_order: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Forced rows in input order, then the rest by order; k in all."""
    keep = [F.when(F.col(forced), F.col(c)) for c in input_order]
    w = Window.partitionBy(*group).orderBy(F.col(forced).desc(), *[c.asc_nulls_last() for c in keep], *order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def conditional_top(df: DataFrame, group: Sequence[str], order: Sequence[Column], threshold: int, k: int) -> DataFrame:
    """All rows of a group of at most `threshold`, else the k best."""
    n = F.count("*").over(Window.partitionBy(*group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumns({"_n": n, "_p": place}).filter((F.col("_n") <= threshold) | (F.col("_p") <= k)).drop("_n", "_p")


def average_rank(value: Column, group: Sequence[str], descending: bool = False) -> Column:
    """Tied values share the mean of their places."""
    w = Window.partitionBy(*group)
    same = Window.partitionBy(*group, value)
    return F.rank().over(w.orderBy(value.desc() if descending else value.asc())) + (F.count("*").over(same) - 1) / 2.0


def shuffled(keys: Sequence[str], seed: int) -> Column:
    """A random order of keys that does not depend on how rows are laid out."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_head(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """A random order, then its head; each task keeps its own n best, nothing is sorted as a whole."""
    return df.orderBy(shuffled(keys, seed), *keys).limit(n)


def sample_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """N rows of each group in a random order, with their place."""
    w = Window.partitionBy(*group).orderBy(shuffled(keys, seed), *keys)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def position(column: Column, order: Sequence[str], unknown: int = 99) -> Column:
    """The place of a value in a fixed order."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), column)
    return F.when(at > 0, at - 1).otherwise(F.lit(unknown)).cast("int")
