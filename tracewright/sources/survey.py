"""The wide survey and its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.text import parse_rank

LABELS = ("A", "B", "C", "D", "E")


def parse_key(lines: DataFrame) -> DataFrame:
    """(task_ord, task_id, dataset, repo_name, pr_number, versions) out of (ord, value) lines.

    Headings are carried forward to the lines below them; a task that lacks a version is an error.
    """
    v = F.trim("value")
    head = r"^##\s+([PA]\d+)\s+\((parsed|trudeau|aidev)\)(?:\s+\S+\s+(.+?)\s+PR\s+#(\d+))?"
    marked = lines.select("ord", v.alias("v"), F.when(v.rlike(head), F.col("ord")).alias("at"))
    filled = marked.withColumn("task", F.last_value("at", ignoreNulls=True).over(Window.partitionBy(F.lit(0)).orderBy("ord")))  # one short document
    version = r"^- Version ([A-E]):\s+([a-z_]+)"
    tasks = filled.filter("task IS NOT NULL").groupBy("task").agg(
        F.max(F.when(F.col("at").isNotNull(), F.col("v"))).alias("h"),
        F.map_from_entries(F.collect_list(F.when(F.col("v").rlike(version), F.struct(F.regexp_extract("v", version, 1), F.regexp_extract("v", version, 2))))).alias("versions"),
    )
    name = F.regexp_extract("h", head, 2)
    missing = F.filter(F.array(*[F.lit(x) for x in LABELS]), lambda x: ~F.array_contains(F.map_keys("versions"), x))
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing version mappings for "), F.regexp_extract("h", head, 1)))).otherwise(F.col("versions"))
    return tasks.select(
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("task")) - 1).alias("task_ord"), F.regexp_extract("h", head, 1).alias("task_id"),
        F.when(name == "aidev", "aidev").otherwise("prsummarizer").alias("dataset"), F.regexp_extract("h", head, 3).alias("repo_name"),
        F.expr(f"try_cast(nullif(regexp_extract(h, r'{head}', 4), '') AS int)").alias("pr_number"), checked.alias("versions"),
    )


def read_key(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return parse_key(text.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value")))


def read_responses(spark: SparkSession, path: str, key: DataFrame) -> DataFrame:
    """(respondent, task_ord, task_id, dataset, mode, rank, best, why).

    A block of seven columns ends with 'Q2 (Best):' and 'Q3 (Why):'; blocks meet tasks by position.
    """
    wide = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    best = [i for i, c in enumerate(wide.columns) if c.startswith("Q2 (Best):")]
    why = [i for i, c in enumerate(wide.columns) if c.startswith("Q3 (Why):")]
    n = key.count()
    if not len(best) == len(why) == n:
        raise ValueError(f"the survey has {len(best)} blocks and {len(why)} reasons, the key {n} tasks")
    named = wide.toDF(*[f"c{i}" for i in range(len(wide.columns))])
    at = lambda i: F.coalesce(F.col(f"c{i}"), F.lit(""))
    blocks = F.array(*[F.struct(F.lit(k).alias("task_ord"), F.array(*[at(b - 5 + j) for j in range(5)]).alias("ranks"), F.trim(at(b)).alias("best"), F.trim(at(w)).alias("why")) for k, (b, w) in enumerate(zip(best, why))])
    rows = named.select(F.monotonically_increasing_id().alias("respondent"), F.explode(blocks).alias("b")).select("respondent", "b.*")
    long = rows.join(F.broadcast(key), "task_ord")  # a key has as many rows as the survey has blocks
    cells = long.select("respondent", "task_ord", "task_id", "dataset", "best", "why", "versions", F.posexplode("ranks").alias("k", "text"))
    label = F.array(*[F.lit(x) for x in LABELS])[F.col("k")]
    mode = F.col("versions")[label]
    return cells.select("respondent", "task_ord", "task_id", "dataset", mode.alias("mode"), parse_rank("text").alias("rank"), F.col("versions")[F.col("best")].alias("best"), "why").filter("rank IS NOT NULL")
