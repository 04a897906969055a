"""Consensus: recovery of planted labels, and awkward votes."""

import random

from pyspark.sql import functions as F

from tracewright.llm import consensus as C

VOTES = "item string, rater string, label string, f double"


def planted(seed=1, items=300):
    rng = random.Random(seed)
    skill = {f"r{i}": s for i, s in enumerate([0.95, 0.9, 0.9, 0.3, 0.25, 0.25, 0.25])}
    truth, rows = {}, []
    for i in range(items):
        y = rng.choice(C.VERSIONS)
        truth[f"i{i}"] = y
        for r, s in skill.items():
            rows.append((f"i{i}", r, y if rng.random() < s else rng.choice(C.VERSIONS), float(C.VERSIONS.index(y)) + rng.gauss(0, 1) if i % 10 else None))
    return truth, rows


def test_beats_the_majority(spark):
    truth, rows = planted()
    q, raters = C.fit_consensus(spark.createDataFrame(rows, VOTES), ["f"], C.VERSIONS)
    best = F.array(*[F.lit(v) for v in C.VERSIONS])[F.array_position("q", F.array_max("q")).cast("int") - 1]
    got = {r["item"]: r["l"] for r in q.select("item", best.alias("l")).collect()}
    right = sum(got[i] == y for i, y in truth.items()) / len(truth)
    most = {}
    for i, _, label, _ in rows:
        most.setdefault(i, []).append(label)
    plain = sum(max(set(v), key=v.count) == truth[i] for i, v in most.items()) / len(truth)
    assert right > plain and right > 0.93
    rel = {r["rater"]: r["reliability"] for r in raters.collect()}
    assert min(rel[f"r{i}"] for i in range(3)) > max(rel[f"r{i}"] for i in range(3, 7))


def test_labels_however_written(spark):
    given = ["full", " FULL", "the original", "cmg-only", "File summaries only", "raw.", "file_summaries_only\n", "skip", "-", "", None, "n/a"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(C.version_of(F.col("x"))).collect()]
    assert got == ["full", "full", "original", "cmg_only", "file_summaries_only", "raw", "file_summaries_only", None, None, None, None, None]


def test_empty_and_single(spark):
    q, raters = C.fit_consensus(spark.createDataFrame([], VOTES), ["f"], C.VERSIONS, rounds=2)
    assert q.count() == 0 and raters.count() == 0
    q, _ = C.fit_consensus(spark.createDataFrame([("a", "r", "raw", None)], VOTES), ["f"], C.VERSIONS, rounds=2)
    assert q.first()["agreement"] is None


def test_query(spark, sf):
    rows = C.p1_consensus(spark, sf).collect()
    assert len({(r["repo_name"], r["pr_number"]) for r in rows}) == len(rows) > 0
    assert all(r["label"] in C.VERSIONS and r["raters"] >= 3 and 0 <= r["agreement"] <= 1 for r in rows)


def labels(q):
    best = F.array(*[F.lit(v) for v in C.VERSIONS])[F.array_position("q", F.array_max("q")).cast("int") - 1]
    return {r["item"]: r["l"] for r in q.select("item", best.alias("l")).collect()}


def test_light_annotators_and_split_items_give_the_same(spark):
    """Matrices by join instead of broadcast, items over several rows instead of one."""
    _, rows = planted(items=60)
    rows += [("big", f"x{k}", C.VERSIONS[k % 3 % 2], None) for k in range(40)]
    df = spark.createDataFrame(rows, VOTES)
    q, raters = C.fit_consensus(df, ["f"], C.VERSIONS, rounds=4)
    want, rel = {r["item"]: r for r in q.collect()}, {r["rater"]: r["reliability"] for r in raters.collect()}
    q2, raters2 = C.fit_consensus(df, ["f"], C.VERSIONS, rounds=4, heavy=9, chunk=4)
    got, rel2 = {r["item"]: r for r in q2.collect()}, {r["rater"]: r["reliability"] for r in raters2.collect()}
    assert want.keys() == got.keys() and rel.keys() == rel2.keys()
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(want[k]["q"], got[k]["q"]))
    assert all(want[k]["n"] == got[k]["n"] and want[k]["agreement"] == got[k]["agreement"] for k in want)
    assert all(abs(rel[k] - rel2[k]) < 1e-6 for k in rel)


def test_the_classifier_counts(spark):
    """Where raters are weak, a telling feature raises the share of right labels; without it they are fewer."""
    rng = random.Random(3)
    truth, rows = {}, []
    for i in range(400):
        y = rng.choice(C.VERSIONS[:2])
        truth[f"i{i}"] = y
        for r in range(3):
            rows.append((f"i{i}", f"r{r}", y if rng.random() < 0.3 else C.VERSIONS[:2][rng.random() < 0.5], (1.5 if y == C.VERSIONS[0] else -1.5) + rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, VOTES)
    right = lambda got: sum(got[i] == y for i, y in truth.items()) / len(truth)
    told, blind = labels(C.fit_consensus(df, ["f"], C.VERSIONS)[0]), labels(C.fit_consensus(df, [], C.VERSIONS)[0])
    assert right(told) > 0.9 > 0.85 > right(blind)
    assert sum(told[i] != blind[i] for i in truth) > 20
