r"""Consensus labels from annotators who disagree, with agreement and reliability.

Items have features; annotators have confusion matrices. Expectation-maximisation fits a ridge-regularised
multinomial classifier of item features and the matrices together: the classifier's output is the prior
of an item's label, the matrices weigh the labels given to it; the resulting distribution over labels
trains both again. The classifier's step minimises a quadratic bound of its loss, so that no round can
make the fit worse; rounds end when the likelihood stops growing.

An item is a row that holds its votes; a round is one pass over these rows, which gives sums by annotator,
and one shuffle of the sums. Annotators with at least total / HEAVY votes, of whom there can be no more than
HEAVY, have their matrices broadcast; the others, each with fewer votes than that, are joined, so that no key
of the join is hot. Items of more than CHUNK votes (or total / HEAVY, if that is more) are kept as several
rows, whose sums meet on the driver: again no more than HEAVY of them.

Defined cases: null or unusable labels, and votes without item or annotator, are left out; an annotator
counts once per item, with the label sent last (of equal times the greater label); items with fewer than
`least` annotators get no consensus but still inform the matrices; ties in the final distribution go to
the earlier class; null features count as the mean; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ensure_checkpoint_dir, table

VERSIONS = ("original", "raw", "cmg_only", "file_summaries_only", "full")
LEAST, ROUNDS, RIDGE = 3, 20, 1.0
#: Annotators with a broadcast matrix, and items kept in several rows, at most.
HEAVY = 200_000
#: Votes in a row of an item, and relative growth of the likelihood below which rounds end.
CHUNK, STILL = 5_000, 1e-6
#: Votes of all annotators together that an annotator's matrix starts with.
LEAN = 3.0


def version_of(label: Column) -> Column:
    """One of the five versions, however written; null for anything else."""
    text = F.trim(F.regexp_replace(F.lower(F.trim(label)), r"[^\p{L}\p{N}]+", " "))
    text = F.regexp_replace(text, r"^(?:the|version|generated) | (?:version|one|description)$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^(?:the|version|generated) ", ""), " ", "_")
    return F.when(text.isin(*VERSIONS), text)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _log_matrices(sums: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """log P(given | true) from sums by (annotator, given, true)."""
    full = sums + prior
    return np.log(full / full.sum(1, keepdims=True))


class _Fit:
    """What a round needs, as plain arrays; travels by broadcast."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, classes: int) -> None:
        self.mean, self.scale, self.classes = mean, scale, classes
        self.weights = np.zeros((classes, len(mean) + 1))
        self.logs: np.ndarray | None = None  # of heavy annotators
        self.split: np.ndarray | None = None  # distributions of the items in several rows

    def inputs(self, x: Sequence) -> np.ndarray:
        raw = np.array([list(r) for r in x], dtype=float).reshape(len(x), len(self.mean))
        return np.column_stack([np.nan_to_num((raw - self.mean) / self.scale), np.ones(len(raw))])

    def votes(self, batch: pd.DataFrame) -> np.ndarray:
        """The sum of the votes' log-likelihoods for each row."""
        out = np.zeros((len(batch), self.classes))
        if self.logs is not None:
            flat = self.logs.reshape(-1, self.classes)
            sizes = batch["hv"].map(len).to_numpy()
            if sizes.sum():
                np.add.at(out, np.repeat(np.arange(len(batch)), sizes), flat[np.concatenate(batch["hv"].tolist()).astype(np.int64)])
        if "cold" in batch:
            for i, v in enumerate(batch["cold"]):
                if v is not None:
                    out[i] += v
        return out

    def posterior(self, batch: pd.DataFrame, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distribution, log-likelihood, inputs) of each row; an item in several rows has its own from the driver."""
        x = self.inputs(batch["x"])
        if first:
            q = np.array(batch["counts"].tolist(), dtype=float) + 0.2
            q, gain = q / q.sum(1, keepdims=True), np.zeros(len(batch))
        else:
            prior = x @ self.weights.T
            z = self.votes(batch) + prior - prior.max(1, keepdims=True)
            gain = np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - np.log(np.exp(prior - prior.max(1, keepdims=True)).sum(1))
            q = _softmax(z)
        at = batch["split"].to_numpy()
        if self.split is not None and (at >= 0).any():
            q[at >= 0] = self.split[at[at >= 0]]
            gain[at >= 0] = 0.0
        return q, gain, x


def fit_consensus(votes: DataFrame, features: Sequence[str], classes: Sequence[str], rounds: int = ROUNDS, ridge: float = RIDGE, heavy: int = HEAVY, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """votes: item, rater, label and the feature columns, one row per item and rater; a row without a label
    only brings features of its item.

    Gives (item, n, q: the distribution over classes, agreement: share of agreeing pairs of raters) and
    (rater, votes, reliability: the chance to name an item's class). The plans of all rounds are alike;
    what changes travels as data, so that no code is generated anew.
    """
    spark = votes.sparkSession
    ensure_checkpoint_dir(spark)
    c, d = len(classes), len(features)
    code = F.create_map(*[F.lit(x) for i, k in enumerate(classes) for x in (k, i)])[F.col("label")]
    coded = votes.select("item", "rater", F.when(F.col("rater").isNotNull(), code).alias("l"), *features).filter("item IS NOT NULL").checkpoint()
    said = coded.filter("l IS NOT NULL")
    total = said.count()
    known = said.groupBy("rater").count().filter(F.col("count") >= max(1, -(-total // heavy))).orderBy("rater").collect()  # at most `heavy`
    most = max(chunk, -(-total // heavy))
    tally = [F.count_if(F.col("l") == k).cast("double") for k in range(c)]
    large = said.groupBy("item").agg(F.count("*").alias("n"), F.array(*tally).alias("counts")).filter(F.col("n") > most).orderBy("item").collect()  # at most `heavy`
    heavy_ids = spark.createDataFrame([(r["rater"], i) for i, r in enumerate(known)], "rater string, hid int")
    split_ids = spark.createDataFrame([(r["item"], i, -(-r["n"] // most), r["n"], r["counts"]) for i, r in enumerate(large)], "item string, split int, pieces int, all_n long, all_counts array<double>")
    placed = coded.join(F.broadcast(heavy_ids), "rater", "left").join(F.broadcast(split_ids), "item", "left")
    piece = F.when(F.col("l").isNull() | F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("rater"), F.col("pieces")).cast("int"))
    rows = (
        placed.groupBy("item", piece.alias("piece"))
        .agg(
            F.coalesce(F.max("split"), F.lit(-1)).alias("split"),
            F.coalesce(F.max("all_n"), F.count("l")).alias("n"),
            F.coalesce(F.max("all_counts"), F.array(*tally)).alias("counts"),
            F.array(*[F.max(f).cast("double") for f in features]).cast("array<double>").alias("x"),
            F.collect_list(F.when(F.col("l").isNotNull() & F.col("hid").isNotNull(), F.col("hid").cast("long") * c + F.col("l"))).alias("hv"),
            F.collect_list(F.when(F.col("l").isNotNull() & F.col("hid").isNull(), F.struct("rater", "l"))).alias("cv"),
        )
        .filter("n > 0")
        .checkpoint()
    )
    cold = rows.filter(F.size("cv") > 0).select("item", "piece", F.explode("cv").alias("v")).select("item", "piece", "v.rater", "v.l") if len(known) < said.select("rater").distinct().count() else None
    each = rows.filter("piece = 0")
    stats = each.agg(*[g(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, g in (("m", F.avg), ("s", F.stddev_samp))]).first() if d else {}
    number = lambda v, other: other if v is None or v != v else v
    fit = _Fit(np.array([number(stats[f"m{i}"], 0.0) for i in range(d)]), np.array([number(stats[f"s{i}"], 0.0) or 1.0 for i in range(d)]), c)
    of_split = np.zeros((len(large), d + 1))
    if large:
        for r in each.filter("split >= 0").select("split", "x").collect():
            of_split[r["split"]] = fit.inputs([[np.nan if v is None else v for v in r["x"]]])[0]
    sums_schema = "kind int, id long, rater string, v array<double>"

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((d + 1, d + 1))
        for batch in batches:
            if len(batch):
                x = fit.inputs(batch["x"])
                g += x.T @ x
        yield pd.DataFrame({"i": range(g.size), "g": g.ravel()})

    square = np.zeros((d + 1) ** 2)
    for r in each.select("x").mapInPandas(gram, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        square[r["i"]] = r["g"]
    penalty = np.kron(np.eye(c), np.diag([ridge] * d + [1e-3]))
    bound = np.linalg.inv(0.5 * np.kron(np.eye(c) - 1.0 / c, square.reshape(d + 1, d + 1)) + penalty)

    def with_cold(some: DataFrame, matrices: DataFrame | None) -> DataFrame:
        if cold is None or matrices is None:
            return some
        sums = cold.join(matrices.select("rater", "l", "ll"), ["rater", "l"]).groupBy("item", "piece").agg(F.array(*[F.sum(F.col("ll")[k]) for k in range(c)]).alias("cold"))
        return some.join(sums, ["item", "piece"], "left")

    def settle(sent, matrices: DataFrame | None) -> np.ndarray | None:
        """The distributions of the items in several rows."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"split": batch["split"], "z": list(sent.value.votes(batch))})

        z = of_split @ fit.weights.T
        some = with_cold(rows.filter("split >= 0"), matrices)
        for r in some.mapInPandas(part, "split int, z array<double>").groupBy("split").agg(F.array(*[F.sum(F.col("z")[k]) for k in range(c)]).alias("z")).collect():
            z[r["split"]] += r["z"]
        return _softmax(z)

    def one_round(sent, matrices: DataFrame | None, first: bool) -> DataFrame:
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now: _Fit = sent.value
            hits: dict[int, np.ndarray] = {}
            gradient, gained = np.zeros((d + 1, c)), 0.0
            for batch in batches:
                if not len(batch):
                    continue
                q, gain, x = now.posterior(batch, first)
                sizes = batch["hv"].map(len).to_numpy()
                if sizes.sum():
                    ids, at = np.unique(np.concatenate(batch["hv"].tolist()).astype(np.int64), return_inverse=True)
                    part = np.zeros((len(ids), c))
                    np.add.at(part, at, np.repeat(q, sizes, axis=0))
                    for i, v in zip(ids.tolist(), part):
                        hits[i] = hits[i] + v if i in hits else v
                own = batch["piece"].to_numpy() == 0
                gradient += x[own].T @ (q - _softmax(x @ now.weights.T))[own]
                gained += float(gain[own].sum())
                told = [(1, r["l"], r["rater"], q[i].tolist()) for i, v in enumerate(batch["cv"]) for r in v]
                if told:
                    yield pd.DataFrame(told, columns=["kind", "id", "rater", "v"])
            out = [(0, i, None, v.tolist()) for i, v in hits.items()] + [(2, j, None, g.tolist()) for j, g in enumerate(gradient)]
            yield pd.DataFrame([*out, (3, 0, None, [gained] + [0.0] * (c - 1))], columns=["kind", "id", "rater", "v"])

        some = with_cold(rows, None if first else matrices)
        return some.mapInPandas(step, sums_schema).groupBy("kind", "id", "rater").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(c)]).alias("v"))

    def cold_logs(sums: DataFrame, prior: np.ndarray) -> DataFrame:
        def logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for rater, given in batch.itertuples(index=False, name=None):
                    m = np.zeros((1, c, c))
                    for r in given:
                        m[0, r["id"]] += r["v"]
                    out += [(rater, k, v.tolist(), float(m.sum())) for k, v in enumerate(_log_matrices(m, prior)[0])]
                yield pd.DataFrame(out, columns=["rater", "l", "ll", "votes"])

        few = sums.filter("kind = 1").groupBy("rater").agg(F.collect_list(F.struct("id", "v")).alias("given"))  # a row per class at most
        return few.mapInPandas(logs, "rater string, l int, ll array<double>, votes double")

    matrices, pooled, last = None, np.full((c, c), 0.5), -np.inf
    heavy_sums = np.zeros((len(known), c, c))
    sent = spark.sparkContext.broadcast(fit)
    for n in range(rounds):
        sums = one_round(sent, matrices, n == 0)
        if cold is not None:
            sums = sums.checkpoint()
        heavy_sums, gradient, gained = np.zeros((len(known), c, c)), np.zeros((d + 1, c)), 0.0
        for r in sums.filter("kind <> 1").collect():
            if r["kind"] == 0:
                heavy_sums[r["id"] // c, r["id"] % c] = r["v"]
            elif r["kind"] == 2:
                gradient[r["id"]] = r["v"]
            else:
                gained = r["v"][0]
        pooled = heavy_sums.sum(0) + 0.5
        if cold is not None:
            for r in sums.filter("kind = 1").groupBy("id").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(c)]).alias("v")).collect():  # a row per class
                pooled[r["id"]] += r["v"]
        prior = LEAN * pooled / pooled.sum(0) + 0.05
        matrices = cold_logs(sums, prior) if cold is not None else None
        fit.logs = _log_matrices(heavy_sums, prior)
        fit.weights = fit.weights + (bound @ (gradient.T.ravel() - penalty @ fit.weights.ravel())).reshape(c, d + 1)
        if large:
            fit.split = None
            fit.split = settle(spark.sparkContext.broadcast(fit), matrices)
        sent.unpersist()
        sent = spark.sparkContext.broadcast(fit)
        if n > 1 and not large and gained - last < STILL * abs(gained):
            break
        last = gained

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"item": batch["item"], "n": batch["n"], "counts": batch["counts"], "q": list(sent.value.posterior(batch, False)[0])})

    same = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x * (x - 1)) / (F.col("n") * (F.col("n") - 1))
    settled = with_cold(each, matrices).mapInPandas(final, "item string, n long, counts array<double>, q array<double>")
    share = pooled.sum(0) / pooled.sum()
    hit = (np.exp(fit.logs)[:, np.arange(c), np.arange(c)] @ share) if fit.logs is not None and len(known) else []
    told = spark.createDataFrame([(r["rater"], float(m), float(h)) for r, m, h in zip(known, heavy_sums.sum((1, 2)), hit)], "rater string, votes double, reliability double")
    if matrices is not None:
        of_l = F.array(*[F.lit(float(s)) for s in share])
        told = told.unionByName(matrices.groupBy("rater").agg(F.max("votes").alias("votes"), F.sum(F.exp(F.col("ll")[F.col("l")]) * of_l[F.col("l")]).alias("reliability")))
    return settled.select("item", "n", "q", F.when(F.col("n") > 1, same).alias("agreement")), told


def rating_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per PR and rater with the usable label sent last; beside them the PRs with their features."""
    sheets = table(spark, sf_dir, "ratings")
    item = lambda repo, number: F.concat_ws("#", repo, F.col(number).cast("string")).alias("item")
    each = F.explode(F.array(F.struct(F.col("rater1").alias("rater"), F.col("c1").alias("raw")), F.struct(F.col("rater2").alias("rater"), F.col("c2").alias("raw"))))
    said = sheets.filter("repo_name IS NOT NULL AND pr_number IS NOT NULL").select(item("repo_name", "pr_number"), "submitted_at", "ingested_at", each.alias("v"))
    usable = said.select("item", "submitted_at", "ingested_at", "v.rater", version_of(F.col("v.raw")).alias("label")).filter("rater IS NOT NULL AND label IS NOT NULL")
    votes = usable.groupBy("item", "rater").agg(F.max_by("label", F.struct("ingested_at", "submitted_at", "label")).alias("label"))
    prs = table(spark, sf_dir, "pull_requests").filter("repo IS NOT NULL AND number IS NOT NULL").select(
        item("repo", "number"),
        F.log1p(F.col("additions").cast("double")).alias("f_add"),
        F.log1p(F.col("deletions").cast("double")).alias("f_del"),
        F.log1p(F.col("changed_files").cast("double")).alias("f_files"),
        F.log1p(F.length("body").cast("double")).alias("f_body"),
        F.length("title").cast("double").alias("f_title"),
    )
    return votes.unionByName(prs, allowMissingColumns=True)


FEATURES = ["f_add", "f_del", "f_files", "f_body", "f_title"]


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fit_consensus(rating_votes(spark, sf_dir), FEATURES, VERSIONS)


def p1_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settled label of each rated PR, its certainty and the raters' agreement."""
    consensus = _fitted(spark, sf_dir)[0]
    best = F.array(*[F.lit(v) for v in VERSIONS])[F.array_position("q", F.array_max("q")).cast("int") - 1]
    repo, number = F.regexp_extract("item", r"^([\s\S]*)#(-?\d+)$", 1), F.regexp_extract("item", r"#(-?\d+)$", 1).cast("int")
    return consensus.filter(F.col("n") >= LEAST).select(
        repo.alias("repo_name"), number.alias("pr_number"), best.alias("label"), F.array_max("q").alias("certainty"), "agreement", F.col("n").alias("raters")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that the raters of a PR settle on."""
    return p1_consensus(spark, sf_dir).select("repo_name", "pr_number", "label")


def p1_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and reliability (chance of naming the settled label) of each rater."""
    return _fitted(spark, sf_dir)[1].select("rater", "votes", "reliability")
