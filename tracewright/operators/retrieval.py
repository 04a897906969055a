"""Ranked retrieval of texts for a stated set of queries, in blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: Queries that go to the executors at a time.
BLOCK = 256
#: Different tokens of the queries of a block, some 100 MB of a worker.
BLOCK_TOKENS = 40_000
#: Documents that a block meets at a time.
CHUNK = 128


def corpus_stats(docs: DataFrame, doc_id: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(token, df, idf) and one row of (n, avgdl); each document counts a token once."""
    whole = docs.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg(F.size(tokens))).alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = F.col("n")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(whole)).select("token", "df", idf.alias("idf")), whole


def _blocks(queries: DataFrame, stats: DataFrame) -> Iterator[list]:
    """Blocks of queries with the weights of their own tokens; the driver holds one block at a time."""
    per = queries.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf")).join(stats, "token")
    weights = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", (F.col("tf") * F.col("idf")).alias("w")))).alias("weights"))
    rows = queries.select("id", "scope", "within", "files", "vector").join(weights, "id", "left").orderBy("id")
    block, seen = [], set()
    for r in rows.toLocalIterator():
        words = set(r["weights"] or ())
        if block and (len(block) == BLOCK or len(seen | words) > BLOCK_TOKENS):
            yield block
            block, seen = [], set()
        block.append(r)
        seen |= words
    if block:
        yield block


def top_demos(docs: DataFrame, queries: DataFrame, k: int = 3, same: bool = False) -> DataFrame:
    """The k best documents of each query.

    docs and queries: id, scope, tokens, size, files, and as they like within and vector. A document of the query's
    own scope (its PR) is left out (Q17 aside, which finds nothing); with `same` so is one of another `within` (its
    repository). Score: half of Jaccard + .2 size + .1 files, a quarter of BM25 brought to 0..1 over the query's
    candidates (Q16), a quarter of the cosine of the vectors (0 without them); equal scores go to the greater id (Q15).

    Queries go in blocks of BLOCK queries and BLOCK_TOKENS different tokens at most, each broadcast by itself; each
    document is read once a block and meets all of its queries; a first pass finds the range of BM25, a second the best.
    """
    spark = docs.sparkSession
    null = {"within": F.lit(None).cast("string"), "vector": F.lit(None).cast("array<float>")}
    docs, queries = (x.withColumns({c: v for c, v in null.items() if c not in x.columns}) for x in (docs, queries))
    stats, whole = corpus_stats(docs, "id", "tokens")
    avgdl = whole.first()["avgdl"]
    kind = docs.schema["id"].dataType.simpleString()
    out = None
    for block in _blocks(queries, stats):
        at_token: dict[str, int] = {}
        for r in block:
            for t in r["weights"] or ():
                at_token.setdefault(t, len(at_token))
        weight = np.zeros((len(block), len(at_token)))
        for i, r in enumerate(block):
            for t, w in (r["weights"] or {}).items():
                weight[i, at_token[t]] = w
        there = np.zeros((len(block), len(at_token)), dtype=np.float32)
        for i, r in enumerate(block):
            there[i, [at_token[t] for t in r["weights"] or ()]] = 1
        unit = [None if r["vector"] is None else np.array(r["vector"], dtype=float) / max(1e-12, float(np.linalg.norm(r["vector"]))) for r in block]
        meta = [(r["id"], r["scope"], r["files"], r["within"], v) for r, v in zip(block, unit)]
        sent = spark.sparkContext.broadcast((at_token, weight, there, meta))

        def scored(batch: pd.DataFrame, packed: tuple) -> Iterator[tuple]:
            """For some documents at a time: ids, and by query and document BM25, base score, exclusion."""
            places, w, has, queries_ = packed
            n_query = has.sum(1)[:, None]
            files_q = np.array([q[2] for q in queries_], dtype=float)[:, None]
            scope_q = np.array([q[1] for q in queries_], dtype=object)[:, None]
            within_q = np.array([q[3] for q in queries_], dtype=object)[:, None]
            dims = next((len(q[4]) for q in queries_ if q[4] is not None), 0)
            vectors_q = np.array([q[4] if q[4] is not None else np.zeros(dims) for q in queries_]) if dims else None
            for at in range(0, len(batch), CHUNK):
                rows = batch.iloc[at : at + CHUNK]
                tf = np.zeros((len(places), len(rows)))
                for j, tokens in enumerate(rows["tokens"]):
                    np.add.at(tf[:, j], [places[t] for t in tokens if t in places], 1)
                length = rows["tokens"].map(len).to_numpy(dtype=float)
                distinct = rows["tokens"].map(lambda t: len(set(t))).to_numpy(dtype=float)
                size, files = rows["size"].to_numpy(dtype=float), rows["files"].to_numpy(dtype=float)
                sat = np.where(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl)), 0.0)
                inter = has @ (tf > 0).astype(np.float32)
                union = n_query + distinct - inter
                jac = np.where((n_query > 0) & (length > 0), inter / np.maximum(union, 1), 0.0)
                size_bonus = 1 - np.minimum(np.abs(n_query - size) / np.maximum(np.maximum(n_query, size), 1), 1)
                files_bonus = 1 - np.minimum(np.abs(files_q - files) / np.maximum(np.maximum(files_q, files), 1), 1)
                out_of = scope_q == rows["scope"].to_numpy(dtype=object)
                if same:
                    out_of = out_of | (within_q != rows["within"].to_numpy(dtype=object))
                base = 0.5 * (jac + 0.2 * size_bonus + 0.1 * files_bonus)
                if vectors_q is not None:
                    v = np.array([np.zeros(dims) if x is None else np.asarray(x, dtype=float) / max(1e-12, float(np.linalg.norm(x))) for x in rows["vector"]])
                    base = base + 0.25 * (vectors_q @ v.T)
                yield rows["id"].to_numpy(), w @ sat, base, out_of

        def span(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            packed = sent.value
            lo, hi = np.full(len(packed[3]), np.inf), np.full(len(packed[3]), -np.inf)
            for batch in batches:
                for _, bm25, _, own in scored(batch, packed):
                    lo = np.minimum(lo, np.where(own, np.inf, bm25).min(1))
                    hi = np.maximum(hi, np.where(own, -np.inf, bm25).max(1))
            seen = np.isfinite(lo)
            yield pd.DataFrame({"q": np.flatnonzero(seen), "lo": lo[seen], "hi": hi[seen]})

        kept = docs.select("id", "scope", "within", "tokens", "size", "files", "vector")
        limits = {r["q"]: (r["lo"], r["hi"]) for r in kept.mapInPandas(span, "q int, lo double, hi double").groupBy("q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        low = np.array([limits.get(i, (0.0, 0.0))[0] for i in range(len(block))])[:, None]
        gap = np.array([limits.get(i, (0.0, 0.0))[1] for i in range(len(block))])[:, None] - low

        def best(batches: Iterator[pd.DataFrame], sent=sent, low=low, gap=gap) -> Iterator[pd.DataFrame]:
            packed = sent.value
            heaps: list[list] = [[] for _ in packed[3]]
            for batch in batches:
                for docs_, bm25, base, own in scored(batch, packed):
                    score = np.round(base + 0.25 * np.where(gap > 0, (bm25 - low) / np.where(gap > 0, gap, 1), 0.0), 9)
                    score[own] = -9.0
                    floor = np.array([h[0][0] if len(h) == k else -8.0 for h in heaps])[:, None]
                    for i, j in zip(*np.nonzero(score >= floor)):
                        push = heapq.heappush if len(heaps[i]) < k else heapq.heappushpop
                        push(heaps[i], (float(score[i, j]), docs_[j]))
            rows = [(packed[3][i][0], d, s) for i, h in enumerate(heaps) for s, d in h]
            yield pd.DataFrame(rows, columns=["query", "id", "score"])

        part = kept.mapInPandas(best, f"query {kind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query {kind}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("id")))
    return out.withColumn("place", place).filter(F.col("place") <= k)
