"""Lists of wanted pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_targets(raw: DataFrame) -> DataFrame:
    """(repo_name, pr_number) from text columns; aliases repo and pr; blanks and non-integers go."""
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have])
    rows = raw.select(pick("repo_name", "repo").alias("repo_name"), pick("pr_number", "pr").alias("_n"))
    return rows.select("repo_name", F.expr("try_cast(_n AS int)").alias("pr_number")).filter("repo_name IS NOT NULL AND pr_number IS NOT NULL")


def parse_ids(raw: DataFrame) -> DataFrame:
    """owner_repo_123; the last underscore parts the number, the first two parts make the name."""
    parts = F.split(F.regexp_extract("id", "^(.*)_([^_]*)$", 1), "_")
    n = F.regexp_extract("id", "^(.*)_([^_]*)$", 2)
    rows = raw.select(parts.alias("p"), n.alias("_n")).filter(F.size("p") >= 2)
    return rows.select(F.concat_ws("/", F.col("p")[0], F.col("p")[1]).alias("repo_name"), F.expr("try_cast(_n AS int)").alias("pr_number")).filter("pr_number IS NOT NULL")


def read_targets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A CSV file with a header; the limit is the caller's."""
    rows = parse_targets(spark.read.csv(path, header=True, inferSchema=False))
    return rows.limit(limit) if limit else rows


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return parse_ids(spark.read.csv(path, header=True, inferSchema=False).select("id")).distinct()


def write_targets(df: DataFrame, path: str) -> None:
    """K2."""
    df.select("repo_name", "pr_number").write.mode("overwrite").csv(path, header=True)
