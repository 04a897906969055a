"""Duplicates: first wins, last wins, upserts, edges, near-duplicates inside a group."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """D3: one row per key, the greatest by order, then by all columns; added up before the shuffle."""
    return _extreme(df, keys, order, F.max)


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the least by order, then by all columns."""
    return _extreme(df, keys, order, F.min)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], agg) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(agg(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of each attribute the last value that isn't null."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def distinct_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "id") -> DataFrame:
    """Edges whose ends both exist, each set of attributes once."""
    ends = nodes.select(node).distinct()
    known = edges.join(ends, edges[src] == ends[node], "left_semi")
    return known.join(ends, known[dst] == ends[node], "left_semi").distinct()


def by_source(df: DataFrame, keys: Sequence[str], priority: Column, order: Sequence[str]) -> DataFrame:
    """One row per key, sources of lower priority number first."""
    return first(df.withColumn("_p", priority), keys, ["_p", *order]).drop("_p")


def _kept(texts: Sequence[str | None], ratio: float, keep: int) -> list[int]:
    heads: list[str] = []
    sizes: list[int] = []
    kept = []
    for i, t in enumerate(texts):
        if not t:
            continue
        at = next((k for k, h in enumerate(heads) if _alike(t, h, ratio)), None)
        if at is None:
            heads.append(t)
            sizes.append(1)
            kept.append(i)
        elif sizes[at] < keep:
            sizes[at] += 1
            kept.append(i)
    return kept


def condensed(texts: Column, ratio: float = 0.9, keep: int = 2) -> Column:
    """Places of the texts of an array that stay: greedy clusters in order, the first `keep` of each.

    An array is a single PR's summaries; empty texts go.
    """

    @F.pandas_udf("array<int>")
    def places(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: _kept(a, ratio, keep) if a is not None else [])

    return places(texts)


def _alike(a: str, b: str, ratio: float) -> bool:
    """The cheap upper bounds of the ratio go first."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio
