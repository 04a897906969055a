r"""Filling containers of fixed capacity with texts, by linear grouping.

Texts longer than a container are cut into full containers and a remainder. Of the rest, lengths above
capacity / 16 are large. They are ranked by length and grouped into groups of equal cardinality, within
which every length counts as the group's largest. For these few lengths the cheapest mix of container
configurations is a small linear programme, solved by column generation; its floor and a first-fit pass
over the few left-overs give the plan. The plan is made from the histogram of lengths, which has no
more rows than the capacity; the texts are put into it by their rank. Texts of small length go best-fit
into the space that is left, bucket by bucket.

Defined cases: a null or empty text has 0 tokens and takes no room, but gets a container; repeated rows
are packed as often as they occur; ties in length are ranked by id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.session import ensure_checkpoint_dir, spread, table

CAPACITY = 4096
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary file.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUPS = 24
#: Rows of small texts, or of containers, that one best-fit task takes on average.
BUCKET_ROWS = 20_000


_HELD: dict[str, object] = {}


def _encoding(name: str, vocabulary: bytes):
    """The tokenizer of a vocabulary file's text; a worker keeps it."""
    import tiktoken

    if name not in _HELD:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _HELD[name] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _HELD[name]


def count_tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, tokens) with the tokens of the whole text. The driver reads the vocabulary file and sends it out."""
    with open(tokenizer, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer, sent.value).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.iloc[:, 0], "tokens": [len(encode(t)) if t else 0 for t in batch.iloc[:, 1]]})

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id").mapInPandas(count, "doc_id long, tokens long")


@dataclass
class Plan:
    """Where the large items go by rank (longest first): interval i starts at starts[i]; its ranks fill
    containers from bases[i] on, per[i] to each; odd ranks at the end are placed one by one."""

    starts: np.ndarray
    bases: np.ndarray
    per: np.ndarray
    containers: int

    def place(self, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.starts, rank, side="right") - 1
        return self.bases[i] + (rank - self.starts[i]) // self.per[i]


def _best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of greatest value; one layer for each further item."""
    best, layers = np.zeros(room + 1), []
    for _ in range(room // int(sizes.min())):
        fresh, pick = best.copy(), np.full(room + 1, -1)
        for g, s in enumerate(sizes.tolist()):
            gain = best[: room + 1 - s] + values[g]
            better = np.flatnonzero(gain > fresh[s:] + 1e-12)
            fresh[s + better], pick[s + better] = gain[better], g
        if (pick < 0).all():
            break
        layers.append(pick)
        best = fresh
    pattern, c = np.zeros(len(sizes)), room
    for pick in reversed(layers):
        if pick[c] >= 0:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, configuration) that covers the demand, by column generation, floor and first fit."""
    basis = np.diag(np.floor(capacity / sizes))
    for _ in range(40 * len(sizes)):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = _best_pattern(dual, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        times, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    times = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    out = [(int(n), basis[:, j].astype(np.int64)) for j, n in enumerate(times) if n]
    left = np.maximum(demand - sum((n * p for n, p in out), np.zeros(len(sizes), dtype=np.int64)), 0)
    open_: list[list] = []
    for g in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[g])):
            slot = next((o for o in open_ if o[0] >= sizes[g]), None)
            if slot is None:
                open_.append(slot := [capacity, np.zeros(len(sizes), dtype=np.int64)])
            slot[0] -= int(sizes[g])
            slot[1][g] += 1
    return out + [(1, p) for _, p in open_]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan for all large items from their histogram {length: items}."""
    lengths = np.array(sorted(histogram, reverse=True), dtype=np.int64)
    ends = np.cumsum([histogram[x] for x in lengths.tolist()]) if len(lengths) else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(lengths) else 0
    if not total:
        return Plan(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), 0)
    edges = np.unique(np.linspace(0, total, min(groups, total) + 1).astype(np.int64))
    first = lengths[np.searchsorted(ends, edges[:-1], side="right")]  # the longest of each group
    sizes, at = np.unique(-first, return_index=True)
    sizes, edges = -sizes, np.append(edges[:-1][np.sort(at)], total)
    taken, base, parts = edges[:-1].copy(), 0, []
    for times, pattern in configurations(sizes, np.diff(edges), capacity):
        for g in np.flatnonzero(pattern):
            n = int(min(times * pattern[g], edges[g + 1] - taken[g]))
            if n > 0:
                parts.append((int(taken[g]), base, int(pattern[g])))
                taken[g] += n
        base += times
    parts.sort()
    return Plan(*(np.array(x, dtype=np.int64) for x in zip(*parts)), base)


def _best_fit(free: list[tuple[int, int]], items: list[tuple], capacity: int, fresh: Iterator[int]) -> list[int]:
    """Containers for items of (…, tokens), longest first, each into the fullest that still has room."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for container, room in free:
        stacks[room].append(container)
        mask |= 1 << room
    out = []
    for item in items:
        size = item[-1]
        fits = mask >> size
        room = size + (fits & -fits).bit_length() - 1 if fits else capacity
        if fits:
            container = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            container = next(fresh)
        stacks[room - size].append(container)
        mask |= 1 << room - size
        out.append(container)
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = f"{TOKENIZER_DIR}/{TOKENIZER_FILE}") -> DataFrame:
    """One row per text or piece of an oversized text: doc_id, piece, tokens, container."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sized = count_tokens(docs, doc_id, text, tokenizer).checkpoint()
    pieces = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    items = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("piece")).select(
        "doc_id", "piece", F.when(F.col("tokens") > capacity, F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity)).otherwise(F.col("tokens")).alias("tokens")
    )
    counts = {int(r["tokens"]): int(r["count"]) for r in items.groupBy("tokens").count().collect()}  # capacity + 1 rows at most
    small = capacity // 16
    large_counts = {k: v for k, v in counts.items() if k > small}
    n_small = sum(counts.values()) - sum(large_counts.values())
    plan = make_plan(large_counts, capacity)
    above, ahead = 0, {}
    for k in sorted(large_counts, reverse=True):
        ahead[k] = above
        above += large_counts[k]

    # Ranks without a window over everything: hot lengths are spread over salts, whose sizes are added up.
    salts = 1 + max(large_counts.values(), default=0) // 200_000
    salted = items.filter(F.col("tokens") > small).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("tokens", "salt").count()
    before = sizes.select("tokens", "salt", (F.sum("count").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("count")).alias("before"))
    within = salted.withColumn("nth", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = within.join(before, ["tokens", "salt"])
    sent = spark.sparkContext.broadcast((plan, np.array([ahead.get(k, 0) for k in range(capacity + 1)], dtype=np.int64)))

    @F.pandas_udf("long")
    def place(tokens: pd.Series, nth: pd.Series, before_: pd.Series) -> pd.Series:
        p, ahead_ = sent.value
        return pd.Series(p.place(ahead_[tokens.to_numpy()] + nth.to_numpy() + before_.to_numpy()))

    large = ranked.select("doc_id", "piece", "tokens", place("tokens", "nth", "before").alias("container"))
    buckets = 1 + max(n_small, plan.containers) // BUCKET_ROWS
    room = large.groupBy("container").agg((F.lit(capacity) - F.sum("tokens")).alias("room")).select(F.pmod("container", F.lit(buckets)).alias("bucket"), "container", "room")
    little = items.filter(F.col("tokens") <= small).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    base = plan.containers + (-plan.containers) % buckets

    def fill(key, free: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True])
        fresh = iter(range(base + int(key[0]), 1 << 62, buckets))
        free = free.sort_values("container")
        where = _best_fit(list(zip(free["container"].tolist(), free["room"].tolist())), list(rows[["doc_id", "tokens"]].itertuples(index=False, name=None)), capacity, fresh)
        return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "tokens": rows["tokens"], "container": where})

    schema = "doc_id long, piece int, tokens long, container long"
    filled = room.groupBy("bucket").cogroup(little.groupBy("bucket")).applyInPandas(fill, schema)
    return large.select("doc_id", F.col("piece").cast("int").alias("piece"), "tokens", "container").unionByName(filled)


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the corpus, or piece of an oversized one, with its container."""
    return pack(table(spark, sf_dir, "documents"))


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room that stays empty."""
    each = p6_assignment(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("used"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (1 - F.sum("used") / (F.count("*") * F.lit(CAPACITY))).alias("empty_share")
    )
