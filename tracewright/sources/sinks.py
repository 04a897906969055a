"""Results as files: tables, reports, graph documents, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.graph import to_node_link


def append_keyed(df: DataFrame, path: str, keys: list[str]) -> None:
    """K1, K3, K4: rows whose key the table doesn't hold are added; nothing is rewritten."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        known = None
    fresh = df if known is None else df.join(known, keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K1: a JSON text per node and link, in one folder per part."""
    to_node_link(nodes, edges).write.mode("overwrite").partitionBy("part").text(path)


def percent(x: Column | str) -> Column:
    """One decimal."""
    return F.format_string("%.1f%%", (F.col(x) if isinstance(x, str) else x) * 100)


def decimals(x: Column | str, n: int = 3) -> Column:
    """A fixed number of decimals; '' for null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.format_string(f"%.{n}f", c.cast("double")), F.lit("")) if n else c.cast("string")


def report_rows(df: DataFrame, headers: list[str], n: int = 3) -> DataFrame:
    """K5: columns in their order, numbers with n decimals."""
    doubles = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.when(F.col(h).isNull(), "").otherwise(F.format_string(f"%.{n}f", F.col(h))).alias(h) if h in doubles else F.col(h) for h in headers])


def write_report(df: DataFrame, path: str, headers: list[str], n: int = 3) -> None:
    """K5: a CSV; K7's plots are made from the same rows elsewhere."""
    report_rows(df, headers, n).coalesce(1).write.mode("overwrite").csv(path, header=True)  # a report has a row per mode


def markdown_rows(df: DataFrame, headers: list[str]) -> DataFrame:
    """K5: a markdown table row per row."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(h).cast("string") for h in headers]), F.lit(" |")).alias("line"))


def rejected(df: DataFrame, reason: Column) -> DataFrame:
    """Rows that a stage leaves out, with the reason."""
    return df.withColumn("reject_reason", reason).filter("reject_reason IS NOT NULL")
