"""Whether a message is replaced by a candidate: scores, grounding, gates."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scores as S
from tracewright.functions import text as T


def _tfidf(a, b) -> float:
    """Over the two token lists alone a token weighs 1 if in both, else 1 + ln 1.5."""
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    x, y = Counter(a), Counter(b)
    alone = (1 + math.log(1.5)) ** 2
    dot = sum(n * y[t] for t, n in x.items() if t in y)
    norm = lambda of, other: math.sqrt(sum(n * n * (1.0 if t in other else alone) for t, n in of.items()))
    return dot / (norm(x, y) * norm(y, x))


def tfidf_cosine(x: Column, y: Column) -> Column:
    """M2, as an Arrow function: counting in array expressions would take time by the square of a diff."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_tfidf(i, j) for i, j in zip(a, b)])

    return cosine(x, y)


def qa_score(t: str, d: str, ds: str, anchors: str, tfidf: str, semantic: Column | None = None) -> Column:
    """M7: agreement of message tokens t with diff tokens d (distinct: ds); without a semantic column that part is 0."""
    overlap = F.least(F.size(F.filter(t, lambda x: F.array_contains(F.col(ds), x))), F.lit(20)) / 20.0
    hits = F.least(F.size(F.filter(t, lambda x: F.array_contains(F.col(anchors), x))), F.lit(3)) / 3.0
    sem = semantic if semantic is not None else F.lit(0.0)
    total = 0.20 * S.jaccard(t, ds) + 0.15 * F.col(tfidf) + 0.55 * sem + 0.10 * overlap + 0.10 * F.when(F.size(anchors) > 0, hits).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def _content(tokens: str) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > 2)


def grounded(tokens: str, expanded_diff: str) -> Column:
    """A content word of the message stands in the diff; a message without any passes."""
    words = F.filter(_content(tokens), lambda t: ~t.isin(*T.ANCHOR_STOP))
    return (F.size(words) == 0) | F.arrays_overlap(T.expand_dotted(words), F.col(expanded_diff))


def strictly_grounded(tokens: str, expanded_diff: str) -> Column:
    """Stop words are taken out after dotted words are taken apart; a message without words fails."""
    words = _content(tokens)
    rest = F.filter(T.expand_dotted(words), lambda t: ~t.isin(*T.ANCHOR_STOP))
    return (F.size(words) > 0) & ((F.size(rest) == 0) | F.arrays_overlap(rest, F.col(expanded_diff)))


def decide(df: DataFrame, original: str, candidate: str, diff: str, ranked: str, verdict: str | None = None, good: float = 0.65) -> DataFrame:
    """Adds status, reason and final; the first gate that holds decides (Q12: any gain is enough).

    Token lists are made once, as columns, before anything looks into them.
    """
    o, c, d = F.col(original), F.col(candidate), F.coalesce(F.col(diff), F.lit(""))
    tokens = df.withColumns({"_ot": T.code_tokens(T.trimmed(original)), "_ct": T.code_tokens(T.trimmed(candidate)), "_d": T.code_tokens(d), "_a": T.anchors(d), "_empty": T.trimmed(d) == ""})
    sets = tokens.withColumns({"_ds": F.array_distinct("_d"), "_dx": F.array_distinct(T.expand_dotted(F.array_distinct("_d"))), "_of": tfidf_cosine(F.col("_ot"), F.col("_d")), "_cf": tfidf_cosine(F.col("_ct"), F.col("_d"))})
    scored = sets.withColumns({"_os": qa_score("_ot", "_d", "_ds", "_a", "_of"), "_cs": qa_score("_ct", "_d", "_ds", "_a", "_cf")})
    reason = (
        F.when(~F.col(ranked), "rank_skip")
        .when(T.is_merge_or_revert(o), "merge_or_revert")
        .when(F.col("_empty"), "patch_unavailable")
        .when(T.is_good_message(o) & (F.col("_os") >= good), "quality_ok")
        .when(T.trimmed(c) == "", "empty_hypothesis")
        .when(~grounded("_ct", "_dx"), "not_grounded")
        .when(~strictly_grounded("_ct", "_dx"), "strict_grounding_fail")
        .when(F.col("_cs") > F.col("_os"), F.when(F.lit(verdict is None) | (F.col(verdict) if verdict else F.lit(True)), "heuristic_improve").otherwise("judge_reject"))
        .otherwise("reject")
    )
    out = scored.withColumn("reason", reason)
    rewritten = F.col("reason") == "heuristic_improve"
    return out.withColumns({"status": F.when(rewritten, "rewritten").otherwise("kept"), "final": F.when(rewritten, c).otherwise(o)}).drop("_ot", "_ct", "_d", "_a", "_ds", "_dx", "_of", "_cf", "_os", "_cs", "_empty")


def merge_rewrites(commits: DataFrame, decisions: DataFrame, sha: str = "sha", message: str = "message") -> DataFrame:
    """Decisions on their commits; the rewritten message is set only where the text changed."""
    joined = commits.join(decisions.select(sha, "status", "reason", "candidate", "final"), sha, "left")
    return joined.withColumn("cmg_rewritten_message", F.when((F.col("status") == "rewritten") & (F.col("final") != F.col(message)), F.col("final")))


def roll_up(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Of the chunks of a judgment the greatest penalties, and all remarks with the number of their chunk."""
    axes = ("correctness", "coverage", "clarity")
    notes = lambda a: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.col(f"{a}_penalties").alias("p")))), lambda s: F.transform(F.coalesce(s["p"], F.array()), lambda x: F.concat(F.lit("[chunk "), s["chunk"].cast("string"), F.lit("] "), x))))
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), *[F.max(F.coalesce(f"{a}_penalty", F.lit(0.0))).alias(f"{a}_penalty") for a in axes], *[notes(a).alias(f"{a}_penalties") for a in axes])
