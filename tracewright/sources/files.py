"""Files of records: newest file, name patterns, JSON lists, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import dataset_of_file


def newest_file(files: DataFrame, pattern: str) -> DataFrame:
    """The file of the greatest change time among those whose name fits; a listing with path and time goes in."""
    return files.filter(F.col("path").rlike(pattern)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def list_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(path, modificationTime) without reading any content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(root).select("path", "modificationTime")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lists with file name, dataset and place; items that are no objects go."""
    rows = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    items = rows.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item"))
    parsed = items.filter(F.ltrim("item").startswith("{")).select("file", "pos", F.from_json("item", schema).alias("r"))
    return parsed.select("file", "pos", dataset_of_file("file").alias("dataset"), "r.*")


def read_summary(spark: SparkSession, path: str, scores: list[str]) -> DataFrame:
    """A summary CSV; scores that are no numbers become null."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.withColumns({s: F.expr(f"try_cast(`{s}` AS double)") for s in scores if s in df.columns})


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: nodes and links of a node-link JSON document."""
    doc = spark.read.option("multiLine", True).schema("nodes array<map<string,string>>, links array<map<string,string>>").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select(F.col("n")["id"].alias("id"), F.col("n")["label"].alias("label"), F.map_filter("n", lambda k, v: ~k.isin("id", "label") & v.isNotNull()).alias("attrs"))
    links = doc.select(F.explode("links").alias("e")).select(F.col("e")["source"].alias("src"), F.col("e")["target"].alias("dst"), F.col("e")["label"].alias("label"), F.map_filter("e", lambda k, v: ~k.isin("source", "target", "label", "key") & v.isNotNull()).alias("attrs"))
    return nodes, links
