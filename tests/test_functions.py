"""Column functions against plain Python on small and awkward inputs."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.functions import paths as P
from tracewright.functions import scores as S
from tracewright.functions import text as T

TEXTS = [None, "", "   ", "Fix #12 in élan_x.py", "Merge branch 'a'", "Add owner/repo#3 and #3, #4", "adding stuff", "日本語 テスト", "x" * 300, "a\r\nb\nc\n", "Prefix the parser now please", "Handle 12 cases of api/v2"]


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(expr("x").alias("y"), "i").orderBy("i").select("y").collect()]


def tokens(t):
    return [w.lower() for w in re.split(r"[^\w./#:+-]+", t or "") if w]


def test_code_tokens(spark):
    assert column(spark, T.code_tokens, TEXTS) == [tokens(t) for t in TEXTS]


def test_word_tokens(spark):
    assert column(spark, T.word_tokens, TEXTS) == [re.findall("[a-z0-9_]+", (t or "").lower()) for t in TEXTS]


def test_lines_follow_python(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", None]
    assert column(spark, T.lines, texts) == [(t or "").splitlines() for t in texts]


def test_issue_refs_keep_first_mention(spark):
    assert column(spark, T.issue_refs, ["#2 a/b#1 #2 #3", None]) == [["#2", "a/b#1", "#3"], []]


def test_expand_dotted(spark):
    df = spark.createDataFrame([(["a.b#c", "x#y", "k::v", "plain", "."],)], "t array<string>")
    assert df.select(T.expand_dotted("t")).first()[0] == ["a", "b#c", "x", "y", "k", "v", "plain"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.ngrams("t", 2)).collect()] == [["a b", "b c"], [], []]


def good(t):
    t = (t or "").strip()
    if not t or re.match(r"\s*(merge|revert)\b", t, re.I) or any(w in t.lower() for w in T.WEAK_WORDS):
        return False
    k = tokens(t)
    first = (tokens(t[:40]) or [""])[0]
    return 8 <= len(t) <= 100 and 3 <= len(k) <= 14 and not first.endswith(("ed", "ing"))


def test_good_message(spark):
    texts = [*TEXTS, "Handle the retry in the cache", "Reverted the commit today", "Adding a new thing here", "Revert the last one now"]
    assert column(spark, T.is_good_message, texts) == [good(t) for t in texts]


def test_imperative_score(spark):
    assert column(spark, T.imperative_score, ["add x", "added x", "foo x", "", None]) == [1.0, 0.0, 0.5, 0.0, 0.0]


def test_slug_and_line(spark):
    assert column(spark, T.slug, ["File Summaries only!", "--", None]) == ["file-summaries-only", "mode", "mode"]
    assert column(spark, T.clean_message_line, ["Here is it: - Add #1.\nmore", None]) == ["Add .1", ""]


def test_clean_markdown(spark):
    assert column(spark, T.clean_markdown, ["```md\n# Head\n* **b** and *i*\n```", None]) == ["Head\nb and i", ""]


def test_penalties_and_themes(spark):
    assert column(spark, T.penalty_category, ["Linked issue gone", "Tests section absent", "tests are missing", "incorrect", "omits x", "bad JSON", None]) == [
        "linked_issue_mismatch", "missing_test_coverage", "missing_test_coverage", "unsupported_specifics", "missing_key_changes", "format_structure", "other",
    ]
    assert column(spark, T.themes, ["Clear and short", None]) == [["clarity_readability", "conciseness"], []]


def test_parse_rank(spark):
    assert column(spark, T.parse_rank, ["1 (best)", " 5 (worst)", "6", "", None]) == [1, 5, None, None, None]


PATHS = ["src/config.py", "src/api/x.py", "tests/x.py", "a/tests/x.py", "a.min.js", "package-lock.json", "x/data/d.json", "data/d.json", "a/.github/workflows/ci.yml", "docs/a.MD", "Dockerfile", "", None, "a\\tests\\b.go", "x/img.PNG"]


def test_paths(spark):
    # A dot bounds no keyword, and a test directory counts below the first level only.
    assert column(spark, P.has_keyword, PATHS[:4]) == [False, True, False, False]
    assert column(spark, P.is_test, PATHS) == [False, False, False, True, False, False, False, False, False, False, False, False, False, True, False]
    assert column(spark, P.is_noise, PATHS) == [False, False, False, False, True, True, True, False, False, False, False, False, False, False, True]
    assert column(spark, P.is_ci, ["a/.github/workflows/ci.yml", "Dockerfile", None]) == [True, True, False]
    assert column(spark, P.is_docs, ["docs/a.MD", "a.py", None]) == [True, False, False]
    assert column(spark, P.language, ["a.tsx", "a.unknown", None]) == ["typescript", None, None]


def test_public_symbols(spark):
    df = spark.createDataFrame([("a.py", "@@ -1 +1 @@\n+def f(x):\n+y = 1\n-class A(B):\n def g(x):"), ("a.txt", "+def f(x):"), (None, None)], "p string, t string")
    got = df.select(P.public_symbols("p", T.added_lines("t")), P.public_symbols("p", T.removed_lines("t"))).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 0), (0, 0)]


def test_jaccard_and_cosine(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(S.jaccard("x", "y")).collect()] == [pytest.approx(1 / 3), 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "x array<double>, y array<double>")
    assert [r[0] for r in v.select(S.cosine("x", "y")).collect()] == [pytest.approx(math.sqrt(0.5)), 0.0]


def test_scores(spark):
    df = spark.createDataFrame([(1.0, None, 0.5), (9.0, 9.0, 9.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(S.judge_score("a", "b", "c")).collect()] == [3.5, 1.0, 5.0]
    assert [r[0] for r in df.select(S.primary_reason("a", "b", "c")).collect()] == ["correctness", "correctness", None]


def test_lcs_and_overlap(spark):
    from tracewright.operators.lexical import _lcs_bits, pair_metrics

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    cases = [("the cat sat on the mat".split(), "the mat sat on a cat".split()), (["a"] * 70, ["a"] * 65 + ["b"]), ([], ["a"])]
    for a, b in cases:
        assert _lcs_bits(a, b) == lcs(a, b)
    df = spark.createDataFrame([("a b a c", "a b b a"), ("", "x"), (None, "x")], "r string, c string")
    rows = pair_metrics(df, "r", "c").collect()
    assert len(rows) == 1
    r, c = Counter("a b a c".split()), Counter("a b b a".split())
    assert rows[0]["m1"] == (r & c).total() and rows[0]["r1"] == pytest.approx(0.75)
