"""Overlap metrics between a reference and a candidate text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scores as S
from tracewright.functions import text as T


def _lcs_bits(a: Sequence[str] | None, b: Sequence[str] | None) -> int:
    """Length of the longest common subsequence; a row of the table of lengths is the bits of one number."""
    if a is None or b is None or not len(a) or not len(b):
        return 0
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & where.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*[tokens[k:] for k in range(n)]))


def pair_metrics(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Columns r1, r2, rl and the counters of BLEU; rows without tokens on either side go (Q33).

    One Arrow function counts all orders: the overlap of two bags of n-grams takes time by the square of
    a text in array expressions, and in proportion to it here.
    """

    @F.pandas_udf("m array<int>, lcs int")
    def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = list(x), list(y)
            rows.append(([(_grams(x, n) & _grams(y, n)).total() for n in range(1, 5)], _lcs_bits(x, y)))
        return pd.DataFrame(rows, columns=["m", "lcs"])

    t = df.withColumns({"_r": T.word_tokens(reference), "_c": T.word_tokens(candidate)}).filter((F.size("_r") > 0) & (F.size("_c") > 0))
    t = t.withColumns({"ref_len": F.size("_r"), "hyp_len": F.size("_c"), "_o": overlap("_r", "_c")})
    t = t.withColumns({f"m{n}": F.col("_o.m")[n - 1] for n in range(1, 5)} | {f"p{n}": F.greatest(F.col("hyp_len") - (n - 1), F.lit(0)) for n in range(1, 5)} | {"_lcs": F.col("_o.lcs")})
    return t.withColumns({
        "r1": S.f1(F.col("m1"), F.col("p1"), F.col("ref_len")), "r2": S.f1(F.col("m2"), F.col("p2"), F.col("ref_len") - 1), "rl": S.f1(F.col("_lcs"), F.col("hyp_len"), F.col("ref_len")),
    }).drop("_r", "_c", "_o", "_lcs")


def bleu(matches: Sequence[Column], possible: Sequence[Column], hyp: Column, ref: Column) -> Column:
    """Add-one on matches and possibles of all four orders, and the brevity penalty."""
    logs = sum((F.log((m + 1.0) / (p + 1.0)) for m, p in zip(matches, possible)), F.lit(0.0))
    brevity = F.when(hyp > ref, 1.0).otherwise(F.exp(1.0 - F.try_divide(ref, hyp)))
    return F.when(hyp == 0, 0.0).otherwise(brevity * F.exp(0.25 * logs))


def mode_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Corpus BLEU and means of the others for each group."""
    sums = [F.sum(f"m{n}") for n in range(1, 5)], [F.sum(f"p{n}") for n in range(1, 5)]
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(bleu(*sums, F.sum("hyp_len"), F.sum("ref_len")), 6).alias("bleu"), F.round(F.avg("r1"), 6).alias("rouge1"), F.round(F.avg("r2"), 6).alias("rouge2"),
        F.round(F.avg("rl"), 6).alias("rougel"), F.round(F.stddev_samp("rl"), 6).alias("rougel_sd"),
    )
