"""Splitting oversized items at natural boundaries by recursive bisection.

A span that is longer than limit - overlap is cut at the strongest boundary in its middle half (a hunk header,
else a line start), of several the one nearest to the midpoint. Where the middle half has none, the cut is
made at the nearest boundary of the sort that the whole text can be cut at (hunks if each fits, else lines if
each fits, else the midpoint itself), so that no piece is a sliver without need. The halves are treated alike
until all fit; then every piece but the first is given the last `overlap` characters before it. Lengths are
code points.

Defined cases: null, empty and fitting texts give one piece at most: a null or empty text none, a text
of at most `limit` characters one piece, which is the text. Repeated rows give repeated pieces. Extra
columns pass through only if they are named in `keys`; so clashing names cannot occur. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import table

LIMIT, OVERLAP = 6000, 400
_HUNK = re.compile(r"^@@ -", re.M)


def _nearest(cuts: Sequence[int], lo: int, hi: int, middle: float) -> int | None:
    """The cut inside (lo, hi) that is nearest to middle; of two as near, the earlier."""
    at = bisect_left(cuts, middle)
    near = [c for c in cuts[max(0, at - 1) : at + 1] if lo < c < hi]
    return min(near, key=lambda c: (abs(c - middle), c)) if near else None


def bisect_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, str]]]:
    """The granularity a text needs and its cores as (start, end, boundary at the start)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    room, n = limit - overlap, len(text)
    if n <= limit:
        return "whole", [(0, n, "start")] if n else []
    hunks = [m.start() for m in _HUNK.finditer(text)]
    lines = [m.end() for m in re.finditer("\n", text)]
    widest = lambda marks: max(b - a for a, b in zip(marks, [*marks[1:], n]))
    if hunks and hunks[0] <= room and widest(hunks) <= room:
        grain = "hunk"
    else:
        grain = "line" if widest([0, *[x for x in lines if x < n]]) <= room else "char"
    cuts: dict[int, str] = {0: "start"}
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            continue
        middle, quarter = (lo + hi) / 2, (hi - lo) / 4
        near, far = (lo + quarter, hi - quarter), (lo, hi)
        sorts = [("hunk", hunks, near)] + [("line", lines, near)] * (grain != "hunk") + [("hunk", hunks, far)] * (grain == "hunk") + [("line", lines, far)] * (grain == "line")
        cut, kind = next(((c, k) for k, marks, (a, b) in sorts if (c := _nearest(marks, a, b, middle)) is not None), ((lo + hi) // 2, "char"))
        kind = "hunk" if kind == "line" and text.startswith("@@ -", cut) else kind
        cuts[cut] = kind
        todo += [(lo, cut), (cut, hi)]
    starts = sorted(cuts)
    return grain, [(a, b, cuts[a]) for a, b in zip(starts, [*starts[1:], n])]


def bisect_items(large: DataFrame, text_col: str, keys: Sequence[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per oversized item, without its text: keys, granularity, starts and kinds of its cuts."""
    schema = T.StructType([large.schema[k] for k in keys] + [T.StructField("granularity", T.StringType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("kinds", T.ArrayType(T.StringType()))])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, text in batch.itertuples(index=False, name=None):
                grain, cores = bisect_text(text, limit, overlap)
                rows.append((*key, grain, [a for a, _, _ in cores], [k for _, _, k in cores]))
            yield pd.DataFrame(rows, columns=schema.names)

    return large.select(*keys, F.col(text_col).alias("_text")).mapInPandas(cut, schema)


def split_items(df: DataFrame, text_col: str, keys: Sequence[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: keys, granularity, piece_no, start, repeat_chars, cut_at, piece.

    One pass; a text that fits is its own piece.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("granularity", T.StringType()),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("repeat_chars", T.IntegerType()),
            T.StructField("cut_at", T.StringType()),
            T.StructField("piece", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, text in batch.itertuples(index=False, name=None):
                grain, cores = bisect_text(text, limit, overlap)
                for i, (a, b, kind) in enumerate(cores):
                    back = min(a, overlap)
                    rows.append((*key, grain, i, a, back, kind, text[a - back : b]))
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(*keys, F.col(text_col).alias("_text")).filter(F.length("_text") > 0).mapInPandas(cut, schema)


def _oversized(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    files = table(spark, sf_dir, "pr_files").select(
        F.lit("patch").alias("field"), F.col("file_id").cast("string").alias("item"), F.lit(0).alias("pos"), F.col("patch").alias("text")
    )
    commits = (
        table(spark, sf_dir, "commits")
        .select("sha", F.posexplode("patches").alias("pos", "p"))
        .select(F.lit("patches").alias("field"), F.col("sha").alias("item"), "pos", F.col("p.patch").alias("text"))
    )
    return files.unionByName(commits).filter(F.length("text") > limit)


KEYS = ["field", "item", "pos"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the diffs of more than 6,000 characters with the boundary at which they can be cut."""
    return bisect_items(_oversized(spark, sf_dir, LIMIT), "text", KEYS).select(*KEYS, F.col("granularity").alias("boundary")).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the pieces themselves. Repeated rows of a table count once: oversized texts, and no others, are shuffled by key and hash."""
    once = _oversized(spark, sf_dir, LIMIT).withColumn("h", F.xxhash64("text")).dropDuplicates([*KEYS, "h"])
    return split_items(once, "text", KEYS)


P5_FOUND_SQL = """
WITH item AS (
  SELECT 'patch' AS field, CAST(file_id AS VARCHAR) AS item, 0 AS pos, patch AS text FROM pr_files
  UNION ALL
  SELECT 'patches', sha, CAST(i - 1 AS INT), patches[i].patch
  FROM commits, UNNEST(RANGE(1, LEN(patches) + 1)) AS u(i)),
big AS (SELECT DISTINCT field, item, pos, text FROM item WHERE LENGTH(text) > 6000),
part AS (
  SELECT *, STRING_SPLIT(text, CHR(10) || '@@ -') AS h, STRING_SPLIT(text, CHR(10)) AS l FROM big),
size AS (
  SELECT field, item, pos,
         LIST_MAX([CASE WHEN i = 1 THEN CASE WHEN STARTS_WITH(text, '@@ -') THEN 0 ELSE 1 END
                        ELSE 4 END + LENGTH(h[i]) + CASE WHEN i < LEN(h) THEN 1 ELSE 0 END
                   FOR i IN RANGE(1, LEN(h) + 1)]) AS hunk,
         LEN(h) + CASE WHEN STARTS_WITH(text, '@@ -') THEN 1 ELSE 0 END AS hunks,
         LIST_MAX([LENGTH(l[i]) + CASE WHEN i < LEN(l) THEN 1 ELSE 0 END FOR i IN RANGE(1, LEN(l) + 1)]) AS line
  FROM part)
SELECT field, item, pos,
       CASE WHEN hunks > 1 AND hunk <= 5600 THEN 'hunk' WHEN line <= 5600 THEN 'line' ELSE 'char' END AS boundary
FROM size
"""

#: Lengths and texts that the pieces of an item must give back, from the tables alone; p5_rebuilt compares.
P5_REBUILT_SQL = """
WITH item AS (
  SELECT 'patch' AS field, CAST(file_id AS VARCHAR) AS item, 0 AS pos, patch AS text FROM pr_files
  UNION ALL
  SELECT 'patches', sha, CAST(i - 1 AS INT), patches[i].patch
  FROM commits, UNNEST(RANGE(1, LEN(patches) + 1)) AS u(i)),
big AS (SELECT DISTINCT field, item, pos, text FROM item WHERE LENGTH(text) > 6000)
SELECT field, item, pos, MD5(text) AS digest, CAST(LENGTH(text) AS BIGINT) AS chars, TRUE AS fits, TRUE AS repeats FROM big
"""


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: each diff put together again from its pieces, whether all pieces fit and whether each repeats the end of the one before."""
    pieces = F.array_sort(F.collect_list(F.struct("piece_no", "repeat_chars", "piece")))
    rows = p5_pieces(spark, sf_dir).groupBy(*KEYS).agg(pieces.alias("p"), F.max(F.length("piece")).alias("most"))
    text = F.array_join(F.transform("p", lambda x: F.substring(x["piece"], x["repeat_chars"] + 1, F.length(x["piece"]))), "")
    back = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.endswith(F.col("p")[i - 1]["piece"], F.substring(F.col("p")[i]["piece"], F.lit(1), F.col("p")[i]["repeat_chars"])))
    return rows.select(*KEYS, F.md5(text).alias("digest"), F.length(text).cast("long").alias("chars"), (F.col("most") <= LIMIT).alias("fits"), F.forall(back, lambda x: x).alias("repeats"))
