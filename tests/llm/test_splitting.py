"""Pieces give their text back, fit, and are cut where they may be."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import splitting as S


def check(text, limit, overlap):
    grain, cores = S.bisect_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in cores) == text
    pieces = [text[a - min(a, overlap) : b] for a, b, _ in cores]
    assert all(len(p) <= limit for p in pieces)
    for p, q, (a, _, _) in zip(pieces, pieces[1:], cores[1:]):
        k = min(a, overlap)
        assert q[:k] == text[a - k : a] and (k == 0 or len(p) < k or p[-k:] == q[:k])
    kinds = {k for _, _, k in cores[1:]}
    if grain == "hunk":
        assert kinds <= {"hunk"}
    if grain == "line":
        assert kinds <= {"hunk", "line"}
    return grain


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["@@ -1 +1 @@\n", "+line of code\n", "-x\n", "\n", "long" * 9, "é\r\n"]), max_size=60))
def test_round_trip(parts):
    check("".join(parts), 40, 7)


def test_grains():
    hunk = "@@ -1 +1 @@\n" + "+" + "a" * 3000 + "\n"
    assert check(hunk * 4, 6000, 400) == "hunk"
    assert check("@@ -1 +1 @@\n" + ("+" + "a" * 98 + "\n") * 90, 6000, 400) == "line"
    assert check("@@ -1 +1 @@\n+" + "a" * 9000, 6000, 400) == "char"
    assert check("a" * 6000, 6000, 400) == "whole" and check("", 6000, 400) == "whole"


def test_frame(spark):
    df = spark.createDataFrame([(1, "x" * 10, 5), (2, None, 5), (3, "", 5), (1, "x" * 10, 5), (4, "ab", 5)], "k int, t string, piece int")
    rows = S.split_items(df, "t", ["k"], 6, 2).collect()
    assert sorted((r["k"], r["piece_no"]) for r in rows).count((1, 0)) == 2 and {r["k"] for r in rows} == {1, 4}
    assert S.split_items(df.limit(0), "t", ["k"]).count() == 0


def test_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("pr_files", "commits"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in S.p5_found(spark, sf).collect()) == sorted(con.execute(S.P5_FOUND_SQL).fetchall())


def test_no_slivers():
    """A hunk header far from the midpoint is no place to cut while lines near it are."""
    text = "@@ -1 +1 @@\n+a\n@@ -9 +9 @@\n" + ("+" + "b" * 58 + "\n") * 350
    _, cores = S.bisect_text(text)
    assert min(b - a for a, b, _ in cores) > 1000 and {k for _, _, k in cores[1:]} == {"line"}


def test_pieces_give_the_diffs_back(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("pr_files", "commits"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in S.p5_rebuilt(spark, sf).collect()) == sorted(con.execute(S.P5_REBUILT_SQL).fetchall())
