"""Issues that a text links to behind a keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The closing keywords and the three forms of a reference.
KEYWORD = r"(?i)\b(close[sd]?|fix(?:es|ed)?|resolve[sd]?)\b(.*)"
REFERENCE = r"(?i)(https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/issues/\d+|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+|#\d+)"


def linked_issues(df: DataFrame, repo: str, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys, keyword_used, issue_repo, issue_number): all references in the rest of a line behind its first keyword, whatever their case."""
    line = df.filter(F.col(text).isNotNull()).select(repo, *keys, F.explode(F.split(text, "\n")).alias("line"))
    ref = line.select(repo, *keys, F.lower(F.regexp_extract("line", KEYWORD, 1)).alias("keyword_used"), F.explode(F.regexp_extract_all(F.regexp_extract("line", KEYWORD, 2), F.lit(REFERENCE), 1)).alias("ref"))
    where = F.when(F.lower("ref").startswith("http"), F.regexp_extract("ref", r"(?i)https?://[^/]+/([\w.-]+/[\w.-]+)/", 1)).when(F.col("ref").startswith("#"), F.col(repo)).otherwise(F.regexp_extract("ref", "^(.*)#", 1))
    return ref.select(*keys, "keyword_used", where.alias("issue_repo"), F.expr("try_cast(regexp_extract(ref, '([0-9]+)$', 1) AS int)").alias("issue_number")).distinct()
