"""Aggregations over judged rows, ranks and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_groups(df: DataFrame, group: Sequence[str], member: str, required: Sequence[str]) -> DataFrame:
    """Rows of groups that have every required member."""
    have = F.size(F.array_intersect(F.collect_set(member).over(Window.partitionBy(*group)), F.array(*[F.lit(x) for x in required])))
    return df.withColumn("_have", have).filter(F.col("_have") == len(required)).drop("_have")


def score_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A1, A3: null statistics for empty groups; a deviation needs two values."""
    r = lambda c: F.round(c, 6)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        r(F.avg("generated_score")).alias("avg_generated"),
        r(F.avg("original_score")).alias("avg_original"),
        r(F.avg(F.col("generated_score") - F.col("original_score"))).alias("avg_delta"),
        r(F.median("generated_score")).alias("median_generated"),
        r(F.stddev_samp("generated_score")).alias("stdev_generated"),
        r(F.avg((F.col("prefers") == "generated").cast("double"))).alias("pref_rate"),
        *[r(F.avg(F.coalesce(F.col(f"{x}_penalty"), F.lit(0.0)))).alias(f"avg_{x}_penalty") for x in ("correctness", "coverage", "clarity")],
    )


def category_counts(df: DataFrame, by: str, record: Sequence[str], category: str, categories: Sequence[str]) -> DataFrame:
    """By mode the records, those with a penalty, penalties and their categories; over all modes, as 'all', the sums.

    df has a row per penalty, and one with a null category for a record without any.
    """
    per = df.groupBy(by, *record).agg(F.count(category).alias("k"), *[F.count_if(F.col(category) == c).alias(c) for c in categories])
    sums = [F.count("*").alias("n"), F.count_if(F.col("k") > 0).alias("penalized"), F.sum("k").alias("total"), *[F.sum(c).alias(c) for c in categories]]
    modes = per.groupBy(by).agg(*sums)
    both = modes.unionByName(modes.groupBy(F.lit("all").alias(by)).agg(*[F.sum(c).alias(c) for c in ("n", "penalized", "total", *categories)]))
    share = lambda x, of: F.round(F.coalesce(F.try_divide(F.col(x), F.col(of)), F.lit(0.0)), 6)
    return both.select("*", share("penalized", "n").alias("penalized_rate"), *[share(c, "total").alias(f"{c}_rate") for c in categories])


def kappa(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group the observed and expected agreement of two raters, and Cohen's kappa (0 where agreement is expected to be 1)."""
    keys = [*by] or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    cells = base.groupBy(*keys, left, right).count()  # as many rows as pairs of labels
    m = cells.withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    rows = m.groupBy(*keys, left).agg(F.sum("count").alias("r"), F.max("n").alias("n"))
    cols = m.groupBy(*keys, F.col(right).alias(left)).agg(F.sum("count").alias("k"))
    expected = rows.join(cols, [*keys, left]).groupBy(*keys).agg(F.sum(F.col("r") * F.col("k") / (F.col("n") * F.col("n"))).alias("e"))
    observed = m.groupBy(*keys).agg(F.sum(F.when(F.col(left) == F.col(right), F.col("count")).otherwise(0)).alias("same"), F.max("n").alias("n"))
    o, e = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0.0))
    value = F.when(F.abs(e - 1) < 1e-12, 0.0).otherwise((o - e) / (1 - e))
    return observed.join(expected, keys, "left").select(*by, "n", o.alias("observed"), e.alias("expected"), value.alias("kappa"))


def tau_b(pairs: DataFrame, by: Sequence[str], left: Column, right: Column) -> DataFrame:
    """Kendall's tau-b from rows that are pairs of items; left and right are their differences; 0 where one side ties throughout."""
    s = F.signum(left) * F.signum(right)
    counted = pairs.groupBy(*by).agg(
        F.count_if(s > 0).alias("concordant"), F.count_if(s < 0).alias("discordant"), F.count_if((left == 0) & (right != 0)).alias("left_ties"), F.count_if((right == 0) & (left != 0)).alias("right_ties"), F.count_if((left == 0) & (right == 0)).alias("both_ties")
    )
    c, d, l, r = (F.col(x).cast("double") for x in ("concordant", "discordant", "left_ties", "right_ties"))
    return counted.withColumn("tau", F.coalesce(F.try_divide(c - d, F.sqrt((c + d + l) * (c + d + r))), F.lit(0.0)))
