"""Rules at their full size, on small tables made for them."""

import hashlib

from tracewright.plans import registry, stages

COMMIT = "repo string, pr_number long, sha string, message string, files_touched array<string>, patches array<struct<filename: string, patch: string>>, ingested_at long"


def commit(sha, patches, number=1, message="Add a parser"):
    return ("o/r", number, sha, message, [f for f, _ in patches], patches, 1)


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def test_whole_patches_differ_behind_the_cap(spark, tmp_path):
    lines = [[f"+line {i}" for i in range(250)] + [end] for end in ("+a", "+b")]
    d = write(spark, tmp_path, "commits", [commit(f"s{i}", [("a.py", "\n".join(x))]) for i, x in enumerate(lines)], COMMIT)
    capped, whole = ({r["sha"]: r["combined"] for r in registry.queries()[n](spark, d).collect()} for n in ("T9_T11_patches", "T9_T11_whole_patches"))
    assert capped["s0"] == capped["s1"] == hashlib.md5("\n".join(lines[0][:200]).encode()).hexdigest()
    assert whole == {f"s{i}": hashlib.md5("\n".join(x).encode()).hexdigest() for i, x in enumerate(lines)}


def test_cuts_of_file_and_commit_lists(spark, tmp_path):
    schema = "repo string, pr_number long, file_id long, path string, patch string, changes long, status string, ingested_at long"
    files = [("o/r", n, n * 1000 + i, f"src/f{i:03}.py", "+x = 1", i, "modified", 1) for n in (15, 16, 25, 26, 200, 201) for i in range(n)]
    d = write(spark, tmp_path, "pr_files", files, schema)
    commits = [commit(f"s{n}{i:02}", [(f"src/f{j:03}.py", "+x") for j in range(i + 1)], n) for n in (8, 9) for i in range(n)]
    write(spark, tmp_path, "commits", [(r[0], 15 if r[1] == 8 else 16, *r[2:]) for r in commits], COMMIT)
    count = lambda name: {r["pr_number"]: r["count"] for r in registry.queries()[name](spark, d).groupBy("pr_number").count().collect()}
    assert count("R1_top_files_25") == {15: 15, 16: 16, 25: 25, 26: 25, 200: 25, 201: 25}
    assert count("R3_R4_conditional_top_25") == {15: 15, 16: 16, 25: 25, 26: 25, 200: 25, 201: 25}
    listed = {r["pr_number"]: (len(r["paths"].split(",")), r["truncated"]) for r in registry.queries()["R13_P3_head_cap_200"](spark, d).collect()}
    assert listed == {15: (15, False), 16: (16, False), 25: (25, False), 26: (26, False), 200: (200, False), 201: (200, True)}
    kept = {r["sha"] for r in registry.queries()["R3_conditional_commits"](spark, d).collect()}
    assert kept == {f"s8{i:02}" for i in range(8)} | {f"s9{i:02}" for i in range(3, 9)}


def test_commits_that_are_rewritten(spark, tmp_path):
    schema = "repo string, pr_number long, file_id long, path string, patch string, changes long, status string, ingested_at long"
    d = write(spark, tmp_path, "pr_files", [("o/r", n, n * 100 + i, f"src/f{i:03}.py", "+x = 1", i, "modified", 1) for n in (8, 9) for i in range(9)], schema)
    long = "\n".join(f"+line_{i} = {i}" for i in range(400)) + "\n+the_end = 1"
    write(spark, tmp_path, "commits", [commit(f"s{n}{i:02}", [(f"src/f{j:03}.py", long) for j in range(i + 1)], n) for n in (8, 9) for i in range(n)], COMMIT)
    for name in ("M21_decisions", "J9_merged"):
        assert {r["sha"] for r in registry.queries()[name](spark, d).filter("reason = 'rank_skip'").collect()} == {"s900", "s901", "s902"}, name
    prompt = stages._asked(spark, d).filter("sha = 's800'").first()["prompt"]
    assert prompt.startswith("Write one imperative line") and "Original: Add a parser" in prompt and prompt.endswith("<ADD> the_end = 1")


def test_commit_evidence(spark, tmp_path):
    private = lambda n: [("a.py", "\n".join(["+    x = 1"] * n))]
    rows = [commit(f"a{i:02}", private(2 + i), 15) for i in range(15)] + [commit(f"b{i:02}", private(2 + i), 30) for i in range(28)]
    rows += [commit("c1", [("a.py", "+def run(x):")], 30), commit("c2", [("README.md", "+x")], 30)]
    got = registry.queries()["R7_whole_commit_evidence"](spark, write(spark, tmp_path, "commits", rows, COMMIT)).orderBy("pr_number", "place").collect()
    assert [r["sha"] for r in got if r["pr_number"] == 15] == [f"a{i:02}" for i in range(15)]
    assert [r["sha"] for r in got if r["pr_number"] == 30] == [f"b{i:02}" for i in range(27, 4, -1)] + ["c2", "c1"]
