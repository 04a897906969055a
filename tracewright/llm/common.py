"""What several operators of the subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The distinct rows of the `rows` keys of least hash, for fitting a model; all if there are no more.

    The keys alone are ranked (each task keeps its first ones); the sample doesn't depend on how rows are laid out.
    """
    at = F.xxhash64(key)
    last = df.select(at.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.filter(at <= F.lit(last)).distinct() if last is not None else df.limit(0)
