"""Operators on small tables with nulls, ties, repeated rows and nothing at all."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import chunking as C
from tracewright.operators import dedupe as D
from tracewright.operators import graph as G
from tracewright.operators import ranking as R
from tracewright.operators import responses, retrieval, rewrite
from tracewright.operators import verdicts as V
from tracewright.operators.issues import linked_issues
from tracewright.operators.ranking import sample_head, sample_per_group
from tracewright.operators.retrieval import top_demos


def test_first_latest_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("b", 1, "y", 1), ("b", 1, "y", 1)], "k string, t int, v string, w int")
    assert {tuple(r) for r in D.first(df, ["k"], ["t"]).collect()} == {("a", 1, "x", None), ("b", 1, "y", 1)}
    assert {tuple(r) for r in D.latest(df, ["k"], ["t"]).collect()} == {("a", 2, None, 5), ("b", 1, "y", 1)}
    assert {tuple(r) for r in D.upsert(df, ["k"], "t").collect()} == {("a", "x", 5), ("b", "y", 1)}
    assert D.latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_condensed(spark):
    df = spark.createDataFrame([(["the same text here", "the same text herf", "the same text herg", "else", "", None],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(D.condensed(F.col("t"))).collect()] == [[0, 1, 3], []]


def test_ranking(spark):
    df = spark.createDataFrame([("p", i, s, f) for i, s, f in [(1, 1.0, False), (2, 3.0, False), (3, 2.0, True), (4, 3.0, False)]], "g string, i int, s double, forced boolean")
    top = R.forced_top(df, ["g"], "forced", ["i"], [F.desc("s"), F.col("i")], 3).orderBy("place").collect()
    assert [r["i"] for r in top] == [3, 2, 4]
    assert R.conditional_top(df, ["g"], [F.desc("s"), F.col("i")], 4, 2).count() == 4
    assert R.conditional_top(df, ["g"], [F.desc("s"), F.col("i")], 3, 2).count() == 2
    ranks = df.withColumn("r", R.average_rank(F.col("s"), ["g"], True)).orderBy("i").collect()
    assert [r["r"] for r in ranks] == [4.0, 1.5, 3.0, 1.5]


def greedy(costs, budget, most=None, base=0):
    out, chunk, cost, n, closed = [], -1, 0, 0, True
    for c in costs:
        if closed or cost + c > budget or most and n >= most:
            chunk, cost, n = chunk + 1, base + c, 1
            closed = cost >= budget
        else:
            cost, n = cost + c, n + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize("args", [(10, None, 0), (10, 2, 0), (10, None, 4)])
def test_chunks(spark, args):
    cases = [[], [3, 3, 3, 3], [12, 1, 1], [10, 10], [5, 5, 1, 9, 1, 1, 1]]
    df = spark.createDataFrame([(c,) for c in cases], "c array<int>")
    assert [r[0] for r in df.select(C.greedy_chunks(F.col("c"), *args)).collect()] == [greedy(c, *args) for c in cases]


def test_budget(spark):
    df = spark.createDataFrame([([20, 1],), ([3, 3, 3, 3, 1],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(C.budget_prefix(F.col("c"), 10)).collect()] == [1, 3, 0]
    assert [r[0] for r in df.select(C.budget_prefix(F.col("c"), None)).collect()] == [2, 5, 0]


def test_kappa_and_tau(spark):
    df = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2, "l string, r string")
    row = A.kappa(df, "l", "r").first()
    o, e = 5 / 6, (4 / 6) * (3 / 6) + (2 / 6) * (3 / 6)
    assert row["kappa"] == pytest.approx((o - e) / (1 - e))
    pairs = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, -1.0), (1, 0.0, 1.0), (1, 1.0, 1.0)], "k int, a double, b double")
    t = A.tau_b(pairs, ["k"], F.col("a"), F.col("b")).first()
    assert t["tau"] == pytest.approx((2 - 1) / math.sqrt(4 * 3))


def test_complete_groups(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "g int, m string")
    assert {r["g"] for r in A.complete_groups(df, ["g"], "m", ["a", "b"]).collect()} == {1}


def test_linked_issues(spark):
    df = spark.createDataFrame([("o/r", "Closes #1, x/y#2 and https://github.com/p/q/issues/3\nsee #9", 1), ("o/r", None, 2), ("o/r", "prefixes #4", 3)], "repo string, m string, k int")
    assert {tuple(r) for r in linked_issues(df, "repo", "m", ["k"]).collect()} == {(1, "closes", "o/r", 1), (1, "closes", "x/y", 2), (1, "closes", "p/q", 3)}
    loud = spark.createDataFrame([("o/r", "FIXED HTTPS://GitHub.com/p/q/Issues/7", 1)], "repo string, m string, k int")
    assert [tuple(r) for r in linked_issues(loud, "repo", "m", ["k"]).collect()] == [(1, "fixed", "p/q", 7)]


def test_edges_need_both_ends(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b", "L"), ("a", "b", "L"), ("a", "b", "M"), ("a", "z", "L")], "src string, dst string, label string")
    assert {tuple(r) for r in D.distinct_edges(e, n).collect()} == {("a", "b", "L"), ("a", "b", "M")}


def test_commit_owner_takes_last_edge(spark):
    e = spark.createDataFrame([("s", "r", 1, "2024-01-01"), ("s", "r", 2, "2024-02-01")], "sha string, repo string, pr_number int, ingested_at string")
    assert tuple(G.commit_owner(e).first()) == ("s", "r", 2)


def test_parse_response(spark):
    cases = ['{"pr_description": "a"}', 'x ```json\n{"pr_description": "b"}\n``` y', 'so {"pr_description": "c\nd"} end', "plain text", None]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = [r[0] for r in df.select(F.from_json(responses.parse_response(F.col("x")), "pr_description string")["pr_description"]).collect()]
    assert got == ["a", "b", "c\nd", "plain text", None]
    arr = spark.createDataFrame([('noise [1,2] x',), ('{"results":[3]}',), ("none",), (None,)], "x string")
    assert [r[0] for r in arr.select(responses.lenient_array(F.col("x"), "int")).collect()] == [[1, 2], [3], None, None]


def test_decisions(spark):
    diff = "<FILE> src/a.py\n<ADD> def retry_count(x):\n<DEL> old_value = 1"
    rows = [
        ("m1", "Merge branch x", "Handle retry_count", diff, True), ("m2", "stuff", "Handle retry_count in a.py", diff, True), ("m3", "stuff", "", diff, True),
        ("m4", "stuff", "Handle nothing known", diff, True), ("m5", "stuff", "Handle retry_count", "", True), ("m6", "stuff", "x", diff, False),
    ]
    df = spark.createDataFrame(rows, "sha string, o string, c string, d string, r boolean")
    got = {r["sha"]: (r["status"], r["reason"]) for r in rewrite.decide(df, "o", "c", "d", "r").collect()}
    assert got == {
        "m1": ("kept", "merge_or_revert"), "m2": ("rewritten", "heuristic_improve"), "m3": ("kept", "empty_hypothesis"), "m4": ("kept", "not_grounded"), "m5": ("kept", "patch_unavailable"), "m6": ("kept", "rank_skip"),
    }


def test_top_demos_against_brute_force(spark):
    texts = {1: "a b c", 2: "a a d", 3: "b c c e", 50: "a b", 4: "", 100: "z"}
    rows = [(i, f"s{i % 2}", t.split(), len(t.split()), i % 3) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "id long, scope string, tokens array<string>, size int, files int")
    got = {(r["query"], r["place"]): (r["id"], round(r["score"], 6)) for r in top_demos(df, df.filter("id % 50 = 0"), 2).collect()}
    docs = {i: (s, t, n, f) for i, s, t, n, f in rows}
    avg = max(1.0, sum(len(d[1]) for d in docs.values()) / len(docs))
    dfreq = {w: sum(w in d[1] for d in docs.values()) for d0 in docs.values() for w in d0[1]}
    for q in (50, 100):
        s, t, _, f = docs[q]
        cands = []
        for i, (s2, t2, n2, f2) in docs.items():
            if s2 == s:
                continue
            bm = sum(math.log(1 + (len(docs) - dfreq[w] + 0.5) / (dfreq[w] + 0.5)) * t2.count(w) * 2.5 / (t2.count(w) + 1.5 * (0.25 + 0.75 * len(t2) / avg)) for w in t if w in t2)
            j = len(set(t) & set(t2)) / len(set(t) | set(t2)) if t and t2 else 0
            base = j + 0.2 * (1 - min(abs(len(set(t)) - n2) / max(len(set(t)), n2, 1), 1)) + 0.1 * (1 - min(abs(f - f2) / max(f, f2, 1), 1))
            cands.append((i, bm, base))
        lo, hi = min(c[1] for c in cands), max(c[1] for c in cands)
        want = sorted(((round(0.5 * b + 0.25 * ((m - lo) / (hi - lo) if hi > lo else 0), 9), i) for i, m, b in cands), reverse=True)[:2]
        assert [got[q, k + 1] for k in range(2)] == [(i, round(sc, 6)) for sc, i in want]


def test_agreement_at_its_edges(spark):
    same = spark.createDataFrame([("a", "a")] * 3, "l string, r string")
    assert [tuple(r) for r in A.kappa(same, "l", "r").collect()] == [(3, 1.0, 1.0, 0.0)]
    both = spark.createDataFrame([("x", "a", "a"), ("x", "b", "b"), ("x", "a", "b"), ("x", "b", "a"), ("y", "a", "b")], "g string, l string, r string")
    assert {r["g"]: round(r["kappa"], 9) for r in A.kappa(both, "l", "r", ["g"]).collect()} == {"x": 0.0, "y": 0.0}
    assert A.kappa(same.limit(0), "l", "r").count() == 0
    ties = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0), (2, 1.0, 1.0), (2, -1.0, 3.0)], "k int, a double, b double")
    got = {r["k"]: (r["left_ties"], r["tau"]) for r in A.tau_b(ties, ["k"], F.col("a"), F.col("b")).collect()}
    assert got == {1: (2, 0.0), 2: (0, 0.0)}


def test_counts_of_records_without_penalties(spark):
    df = spark.createDataFrame([("raw", 1, "x"), ("raw", 1, "y"), ("raw", 2, None), ("full", 1, "x")], "mode string, pr int, c string")
    got = {r["mode"]: (r["n"], r["penalized"], r["total"], r["x"], r["penalized_rate"]) for r in A.category_counts(df, "mode", ["pr"], "c", ["x", "y"]).collect()}
    assert got == {"raw": (2, 1, 2, 1, 0.5), "full": (1, 1, 1, 1, 1.0), "all": (3, 2, 3, 2, round(2 / 3, 6))}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    a, b = (sorted(r["id"] for r in sample_head(df.repartition(n), ["id"], 20, 5).collect()) for n in (1, 9))
    assert a == b and len(set(a)) == 20 and a != sorted(r["id"] for r in sample_head(df, ["id"], 20, 6).collect())
    assert sample_per_group(df, ["g"], ["id"], 7).groupBy("g").count().filter("count = 7").count() == 3


def test_verdicts(spark):
    said = spark.createDataFrame([(" b) is better",), ("A",), ("neither",), (None,)], "a string")
    assert [r[0] for r in said.select(V.read_verdict(F.col("a"), True)).collect()] == [True, False, None, None]
    assert [r[0] for r in spark.createDataFrame([("yes",), ("No.",), ("A",)], "a string").select(V.read_verdict(F.col("a"), False)).collect()] == [True, False, None]
    batch = spark.createDataFrame([('Well: [{"sha": "x", "accept": true, "winner": "original"}, {"sha": "y"}]', s) for s in ("x", "y", "z")] + [("no", "x"), (None, "x")], "a string, sha string")
    assert [r[0] for r in batch.select(V.read_batch(F.col("a"), F.col("sha"), False)).collect()] == [True, False, False, False, False]
    assert [r[0] for r in batch.select(V.read_batch(F.col("a"), F.col("sha"), True, False)).collect()] == [True] * 5


def test_demos_of_a_repository_and_with_vectors(spark):
    rows = [(f"{i:02d}", f"pr{i // 2}", f"r{i % 2}", ["a", "b", f"t{i % 5}"], 3, i % 3, [float(i), 1.0] if i != 3 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, scope string, within string, tokens array<string>, size int, files int, vector array<float>")
    q = df.filter("id IN ('00', '05')")
    inside = top_demos(df.drop("vector"), q.drop("vector"), 20, same=True).collect()
    assert {(r["query"], r["id"]) for r in inside} == {(a, b) for a, s, w, *_ in rows if a in ("00", "05") for b, s2, w2, *_ in rows if s != s2 and w == w2}
    plain, vectors = ({(r["query"], r["id"]): r["score"] for r in top_demos(*x, 20).collect()} for x in ((df.drop("vector"), q.drop("vector")), (df, q)))
    cosine = lambda a, b: (a * b + 1) / (math.sqrt(a * a + 1) * math.sqrt(b * b + 1))
    assert all(abs(vectors[k] - plain[k] - (0.0 if k[1] == "03" else 0.25 * cosine(int(k[0]), int(k[1])))) < 1e-6 for k in plain)
    assert top_demos(df, q.limit(0), 2).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7}", [f"t{i % 4}", f"t{i % 9}", "z"], 3, i % 3) for i in range(60)], "id long, scope string, tokens array<string>, size int, files int")
    whole = sorted(tuple(r) for r in top_demos(df, df.filter("id % 5 = 0"), 3).collect())
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    monkeypatch.setattr(retrieval, "BLOCK_TOKENS", 6)
    assert sorted(tuple(r) for r in top_demos(df, df.filter("id % 5 = 0"), 3).collect()) == whole
