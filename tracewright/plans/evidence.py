"""Queries over files and commits: predicates, diff counts, scores, selection, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import paths as P
from tracewright.functions import scores as S
from tracewright.functions import text as T
from tracewright.operators.dedupe import latest
from tracewright.operators.ranking import conditional_top, forced_top
from tracewright.operators.rewrite import tfidf_cosine
from tracewright.plans import sqlparts as Q
from tracewright.session import table

FILE_KEYS = ["repo", "pr_number", "file_id"]
#: The version of a file row received last; equal times differ in nothing but the time.
FILES_SQL = "files AS (SELECT * FROM pr_files QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pr_files")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Narrow score rows first, the last version of each after: no patch is shuffled."""
    rows = _files(spark, d).select(
        *FILE_KEYS, "path", "ingested_at", "changes",
        S.file_score("path", "patch", "changes", "status").alias("score"),
        P.missing_reason("path", "patch").alias("reason"),
        P.is_docs("path").alias("is_docs"),
        F.coalesce(P.api_impact("patch"), F.lit(False)).alias("api"),
        F.size(T.lines("patch")).alias("diff_lines"),
    )
    return latest(rows, ["file_id"], ["ingested_at"])


SCORED_SQL = f"""{FILES_SQL},
scored AS (SELECT repo, pr_number, file_id, path, changes, {Q.file_score()} AS score, {Q.missing_reason('path', 'patch')} AS reason,
  {Q.is_docs('path')} AS is_docs, {Q.api_impact('patch')} AS api, LEN({Q.lines('patch')}) AS diff_lines FROM files)"""


def path_flags(spark: SparkSession, d: str) -> DataFrame:
    """What each path says about its file."""
    return _files(spark, d).select(
        "file_id",
        P.is_noise("path").alias("is_noise"),
        P.is_test("path").alias("is_test"),
        P.is_ci("path").alias("is_ci"),
        P.has_keyword("path").alias("has_keyword"),
        P.is_docs("path").alias("is_docs"),
        P.language("path").alias("language"),
    ).distinct()


PATH_FLAGS_SQL = f"""SELECT DISTINCT file_id, {Q.is_noise('path')} AS is_noise, {Q.is_test('path')} AS is_test, {Q.is_ci('path')} AS is_ci,
{Q.has_keyword('path')} AS has_keyword, {Q.is_docs('path')} AS is_docs, {Q.language('path')} AS language FROM pr_files"""


def missing_patch(spark: SparkSession, d: str) -> DataFrame:
    """Files that give no evidence, with the reason."""
    return _files(spark, d).select("file_id", P.missing_reason("path", "patch").alias("reason")).filter("reason IS NOT NULL").distinct()


MISSING_SQL = f"SELECT DISTINCT file_id, {Q.missing_reason('path', 'patch')} AS reason FROM pr_files WHERE reason IS NOT NULL"


def ignored_counts(spark: SparkSession, d: str) -> DataFrame:
    """P10: files of each PR that are used, are noise, or lack a patch."""
    rows = latest(_files(spark, d).select(*FILE_KEYS, "ingested_at", P.missing_reason("path", "patch").alias("reason")), ["file_id"], ["ingested_at"])
    return rows.groupBy("repo", "pr_number").agg(
        F.count("*").alias("files"), F.count_if(F.col("reason") == "noise_excluded").alias("noise_excluded"), F.count_if(F.col("reason") == "patch_missing").alias("patch_missing")
    )


IGNORED_SQL = f"""WITH {FILES_SQL}, r AS (SELECT repo, pr_number, {Q.missing_reason('path', 'patch')} AS reason FROM files)
SELECT repo, pr_number, COUNT(*) AS files, COUNT(*) FILTER (WHERE reason = 'noise_excluded') AS noise_excluded, COUNT(*) FILTER (WHERE reason = 'patch_missing') AS patch_missing FROM r GROUP BY 1, 2"""


def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and changed lines of each patch."""
    return _files(spark, d).select(
        "file_id", F.size(T.added_lines("patch")).alias("added"), F.size(T.removed_lines("patch")).alias("removed"), F.size(T.changed_lines("patch")).alias("changed")
    ).distinct()


DIFF_COUNTS_SQL = f"SELECT DISTINCT file_id, LEN({Q.changed('patch', '+')})::INT AS added, LEN({Q.changed('patch', '-')})::INT AS removed, LEN({Q.both('patch')})::INT AS changed FROM pr_files"


def public_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Declared public symbols that come and go, and whether a declaration changes at all."""
    return _files(spark, d).select(
        "file_id",
        P.public_symbols("path", T.added_lines("patch")).alias("public_added"),
        P.public_symbols("path", T.removed_lines("patch")).alias("public_removed"),
        P.api_impact("patch").alias("api_impact"),
    ).distinct()


def _public_sql(sign: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN LEN([y FOR y IN {Q.changed('patch', sign)} IF REGEXP_MATCHES(y, '{p}')])" for k, p in P.PUBLIC.items())
    return f"COALESCE(CASE {Q.language('path')} {arms} END, 0)::INT"


PUBLIC_SQL = f"SELECT DISTINCT file_id, {_public_sql('+')} AS public_added, {_public_sql('-')} AS public_removed, {Q.api_impact('patch')} AS api_impact FROM pr_files"


def file_scores(spark: SparkSession, d: str) -> DataFrame:
    """M11."""
    return _scored(spark, d).select("file_id", F.round("score", 6).alias("score"))


FILE_SCORES_SQL = f"WITH {SCORED_SQL} SELECT file_id, ROUND(score, 6) AS score FROM scored"


def _by_score(order: str = "file_id") -> list[Column]:
    return [F.round("score", 6).desc(), F.col(order)]


def top_files(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """K files of each PR: those with a changed declaration first in their order, then by score."""
    rows = _scored(spark, d).filter("reason IS NULL")
    return forced_top(rows, ["repo", "pr_number"], "api", ["file_id"], _by_score(), k).select("repo", "pr_number", "file_id", F.col("place").alias("place"))


TOP_FILES_SQL = f"""WITH {SCORED_SQL}
SELECT repo, pr_number, file_id, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY api DESC, CASE WHEN api THEN file_id END, ROUND(score, 6) DESC, file_id)::INT AS place
FROM scored WHERE reason IS NULL QUALIFY place <= 5"""


def top_files_25(spark: SparkSession, d: str) -> DataFrame:
    """R1 with the reference's 25 files."""
    return top_files(spark, d, 25)


TOP_FILES_25_SQL = TOP_FILES_SQL.replace("place <= 5", "place <= 25")


def conditional_files(spark: SparkSession, d: str, threshold: int = 4, k: int = 3) -> DataFrame:
    """All files of a PR if there are `threshold` at most, else the best k, in the order they had."""
    rows = _scored(spark, d).filter("reason IS NULL")
    return conditional_top(rows, ["repo", "pr_number"], _by_score(), threshold, k).select("repo", "pr_number", "file_id", F.row_number().over(Window.partitionBy("repo", "pr_number").orderBy("file_id")).alias("ord"))


CONDITIONAL_SQL = f"""WITH {SCORED_SQL}, r AS (SELECT *, COUNT(*) OVER (PARTITION BY repo, pr_number) AS n, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY ROUND(score, 6) DESC, file_id) AS p FROM scored WHERE reason IS NULL)
SELECT repo, pr_number, file_id, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY file_id)::INT AS ord FROM r WHERE n <= 4 OR p <= 3"""


def conditional_files_25(spark: SparkSession, d: str) -> DataFrame:
    """R3, R4 with the reference's numbers for files: all if 15 at most, else the best 25."""
    return conditional_files(spark, d, 15, 25)


CONDITIONAL_25_SQL = CONDITIONAL_SQL.replace("n <= 4 OR p <= 3", "n <= 15 OR p <= 25")


def docs_top(spark: SparkSession, d: str) -> DataFrame:
    """The 5 documentation files of a PR with most diff lines, then score."""
    rows = _scored(spark, d).filter("is_docs")
    place = F.row_number().over(Window.partitionBy("repo", "pr_number").orderBy(F.desc("diff_lines"), *_by_score()))
    return rows.withColumn("place", place).filter("place <= 5").select("repo", "pr_number", "file_id", "place")


DOCS_TOP_SQL = f"""WITH {SCORED_SQL} SELECT repo, pr_number, file_id, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY diff_lines DESC, ROUND(score, 6) DESC, file_id)::INT AS place
FROM scored WHERE is_docs QUALIFY place <= 5"""


def head_cap(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    """The file list of each PR, capped, and whether it was."""
    rows = latest(_files(spark, d).select(*FILE_KEYS, "path", "ingested_at"), ["file_id"], ["ingested_at"])
    listed = rows.groupBy("repo", "pr_number").agg(F.array_sort(F.collect_list(F.struct("file_id", "path"))).alias("l"))
    return listed.select("repo", "pr_number", F.array_join(F.transform(F.slice("l", 1, most), lambda x: x["path"]), ",").alias("paths"), (F.size("l") > most).alias("truncated"))


HEAD_CAP_SQL = f"""WITH {FILES_SQL}, l AS (SELECT repo, pr_number, LIST(path ORDER BY file_id) AS l FROM files GROUP BY 1, 2)
SELECT repo, pr_number, ARRAY_TO_STRING(l[1:5], ',') AS paths, LEN(l) > 5 AS truncated FROM l"""


def head_cap_200(spark: SparkSession, d: str) -> DataFrame:
    """R13, P3 with the reference's 200 files."""
    return head_cap(spark, d, 200)


HEAD_CAP_200_SQL = HEAD_CAP_SQL.replace("[1:5]", "[1:200]").replace("> 5", "> 200")


def _commits(spark: SparkSession, d: str, *extra: Column | str) -> DataFrame:
    return table(spark, d, "commits").select("sha", *extra)


def _annotated(df: DataFrame) -> DataFrame:
    """The quality annotations of commits; the semantic part is 0 without vectors."""
    staged = df.select(
        "sha",
        T.trimmed("message").alias("m"),
        F.coalesce("files_touched", F.array()).alias("touched"),
        T.code_tokens(T.trimmed("message")).alias("t"),
        T.patch_tokens("patches").alias("dt"),
        F.aggregate(F.coalesce("patches", F.array()), F.lit(0), lambda s, p: s + F.size(T.added_lines(p["patch"]))).alias("add_lines"),
        F.aggregate(F.coalesce("patches", F.array()), F.lit(0), lambda s, p: s + F.size(T.removed_lines(p["patch"]))).alias("del_lines"),
    ).withColumns({
        "good": T.is_good_message("m"), "merge": T.is_merge_or_revert("m"), "n": F.size("t"), "len": F.length("m"),
        "verb": T.imperative_score("m") > 0, "di": T.identifiers("dt"), "mi": T.identifiers("t"), "ds": F.array_distinct("dt"),
    })
    overlap = F.size(F.array_intersect("di", "mi")) > 0
    bonus = F.least(F.size(F.filter("t", lambda x: F.array_contains("ds", x))), F.lit(20)) / 20.0
    ungrounded = (F.size("di") > 0) & ~overlap
    rule = (
        F.when(ungrounded, "not_grounded").when(F.col("good"), "good").when(F.col("merge"), "merge_or_revert").when((F.col("len") < 8) | (F.col("n") < 3), "too_short")
        .when((F.col("len") > 100) | (F.col("n") > 14), "too_long").when(~F.col("verb"), "not_imperative").when(T.has_weak_word("m"), "vague_word").otherwise("needs_rewrite")
    )
    return staged.select(
        "sha", F.col("m"), (F.col("good") & ~ungrounded).alias("is_good"), (~F.col("merge") & ~(F.col("good") & ~ungrounded)).alias("needs_rewrite"), rule.alias("rule"),
        F.col("len").alias("msg_len"), F.col("n").alias("token_count"), F.col("verb").alias("starts_with_verb"), F.col("merge").alias("is_merge"),
        (F.size("mi") > 0).alias("has_identifier"), F.exists("t", lambda x: x.rlike("[/.]")).alias("has_path"), overlap.alias("identifier_overlap"),
        T.issue_refs("m").alias("issue_refs"), F.exists("touched", lambda f: F.lower(f).rlike("/test|^test_")).alias("has_tests"), F.size("touched").alias("files_touched"),
        "add_lines", "del_lines", F.size("dt").alias("diff_tokens"), F.round(bonus, 4).alias("overlap_bonus"),
        F.least(F.lit(1.0), 0.20 * S.jaccard("t", "ds") + 0.15 * tfidf_cosine(F.col("t"), F.col("dt")) + 0.10 * bonus).alias("quality"),
    )


def commit_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The annotations that need no counting of tokens against the diff."""
    a = _annotated(table(spark, d, "commits"))
    return a.select(
        "sha", "is_good", "needs_rewrite", "rule", "msg_len", "token_count", "starts_with_verb", "is_merge", "has_identifier", "has_path", "identifier_overlap",
        F.array_join("issue_refs", ",").alias("issue_refs"), "has_tests", "files_touched", "add_lines", "del_lines", "diff_tokens", F.round("overlap_bonus", 4).alias("overlap_bonus"),
    ).distinct()


ANNOTATED_SQL = f"""base AS (SELECT DISTINCT sha, {Q.trimmed('message')} AS m, COALESCE(files_touched, []) AS touched,
  FLATTEN([{Q.changed('p.patch', '+')} FOR p IN COALESCE(patches, [])]) AS al, FLATTEN([{Q.changed('p.patch', '-')} FOR p IN COALESCE(patches, [])]) AS dl,
  FLATTEN([{Q.both('p.patch')} FOR p IN COALESCE(patches, [])]) AS cl FROM commits),
tok AS (SELECT *, {Q.code_tokens('m')} AS t, {Q.code_tokens("ARRAY_TO_STRING(cl, ' ')")} AS dt FROM base),
flag AS (SELECT *, {Q.good('m')} AS good, {Q.merge('m')} AS is_merge, LEN(t) AS n, LENGTH(m) AS len, {Q.imperative('m')} > 0 AS verb, {Q.weak('m')} AS vague,
  LIST_DISTINCT([x FOR x IN dt IF {Q.ident('x')}]) AS di, LIST_DISTINCT([x FOR x IN t IF {Q.ident('x')}]) AS mi FROM tok),
fin AS (SELECT *, LEN(LIST_INTERSECT(di, mi)) > 0 AS io, LEST.b AS bonus FROM flag, LATERAL (SELECT LEAST(LEN([x FOR x IN t IF LIST_CONTAINS(dt, x)]), 20) / 20.0::DOUBLE AS b) LEST)"""
ANNOTATIONS_SQL = f"""WITH {ANNOTATED_SQL}
SELECT DISTINCT sha, good AND NOT (LEN(di) > 0 AND NOT io) AS is_good, NOT is_merge AND NOT (good AND NOT (LEN(di) > 0 AND NOT io)) AS needs_rewrite,
CASE WHEN LEN(di) > 0 AND NOT io THEN 'not_grounded' WHEN good THEN 'good' WHEN is_merge THEN 'merge_or_revert' WHEN len < 8 OR n < 3 THEN 'too_short' WHEN len > 100 OR n > 14 THEN 'too_long'
  WHEN NOT verb THEN 'not_imperative' WHEN vague THEN 'vague_word' ELSE 'needs_rewrite' END AS rule,
len::INT AS msg_len, n::INT AS token_count, verb AS starts_with_verb, is_merge, LEN(mi) > 0 AS has_identifier, LEN([x FOR x IN t IF REGEXP_MATCHES(x, '[/.]')]) > 0 AS has_path, io AS identifier_overlap,
ARRAY_TO_STRING([r.k FOR r IN LIST_SORT([{{'i': LIST_POSITION(REGEXP_EXTRACT_ALL(m, '{T.ISSUE_REF}'), k), 'k': k}} FOR k IN LIST_DISTINCT(REGEXP_EXTRACT_ALL(m, '{T.ISSUE_REF}'))])], ',') AS issue_refs,
LEN([f FOR f IN touched IF REGEXP_MATCHES(LOWER(f), '/test|^test_')]) > 0 AS has_tests, LEN(touched)::INT AS files_touched, LEN(al)::INT AS add_lines, LEN(dl)::INT AS del_lines, LEN(dt)::INT AS diff_tokens, ROUND(bonus, 4) AS overlap_bonus FROM fin"""


def message_quality(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2, M6: quality of each message against its diff."""
    return _annotated(table(spark, d, "commits")).select("sha", F.round("quality", 6).alias("quality")).distinct()


MESSAGE_QUALITY_SQL = f"""WITH {ANNOTATED_SQL},
both_ AS (SELECT sha, m, bonus, t, dt, LIST_INTERSECT(LIST_DISTINCT(t), LIST_DISTINCT(dt)) AS b, LEN(LIST_DISTINCT(t || dt)) AS u FROM fin),
w AS (SELECT sha, m, bonus, LEN(b) AS inter, u, LEN(t) AS nt, LEN(dt) AS nd, b, t, dt FROM both_),
ct AS (SELECT sha, m, x, COUNT(*) AS c, ANY_VALUE(LIST_CONTAINS(b, x)) AS inb FROM (SELECT sha, m, b, UNNEST(t) AS x FROM w) GROUP BY 1, 2, 3),
cd AS (SELECT sha, m, x, COUNT(*) AS c, ANY_VALUE(LIST_CONTAINS(b, x)) AS inb FROM (SELECT sha, m, b, UNNEST(dt) AS x FROM w) GROUP BY 1, 2, 3),
nt AS (SELECT sha, m, SQRT(SUM(POW(c * CASE WHEN inb THEN 1.0 ELSE 1 + LN(1.5::DOUBLE) END, 2))) AS v FROM ct GROUP BY 1, 2),
nd AS (SELECT sha, m, SQRT(SUM(POW(c * CASE WHEN inb THEN 1.0 ELSE 1 + LN(1.5::DOUBLE) END, 2))) AS v FROM cd GROUP BY 1, 2),
dot AS (SELECT ct.sha, ct.m, SUM(ct.c * cd.c)::DOUBLE AS v FROM ct JOIN cd ON ct.sha = cd.sha AND ct.m = cd.m AND ct.x = cd.x GROUP BY 1, 2)
SELECT DISTINCT w.sha, ROUND(LEAST(1.0::DOUBLE, 0.20 * CASE WHEN w.nt > 0 AND w.nd > 0 THEN inter / u::DOUBLE ELSE 0 END + 0.15 * COALESCE(dot.v / (nt.v * nd.v), 0) + 0.10 * bonus), 6) AS quality
FROM w LEFT JOIN nt ON w.sha = nt.sha AND w.m = nt.m LEFT JOIN nd ON w.sha = nd.sha AND w.m = nd.m LEFT JOIN dot ON w.sha = dot.sha AND w.m = dot.m"""


def _pr_commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits")


def commit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Commits of a PR by the scores of their files and their intent; unknown files score 0."""
    w = S.CommitWeights()
    scores = _scored(spark, d).groupBy("repo", "pr_number", "path").agg(F.max_by("score", "file_id").alias("score"))
    commits = _pr_commits(spark, d)
    keys = ["repo", "pr_number", "sha"]
    touched = commits.select(*keys, F.explode(F.coalesce("files_touched", F.array())).alias("path"), "ingested_at")
    one = latest(commits.select(*keys, "ingested_at", T.issue_refs(T.trimmed("message")).alias("refs")), keys, ["ingested_at"])
    impact = touched.drop("ingested_at").distinct().join(scores, ["repo", "pr_number", "path"], "left").groupBy(*keys).agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("impact"))
    full = one.join(impact, keys, "left")
    intent = F.when(F.size("refs") > 0, w.issue_link).otherwise(0.0)
    score = F.round(w.impact * F.coalesce("impact", F.lit(0.0)) + w.intent * intent, 6)
    return full.select(*keys, score.alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("repo", "pr_number").orderBy(F.desc("score"), "sha")))


COMMIT_SCORES_SQL = f"""WITH {SCORED_SQL}, fs AS (SELECT repo, pr_number, path, ARG_MAX(score, file_id) AS score FROM scored GROUP BY 1, 2, 3),
c AS (SELECT repo, pr_number, sha, LEN(REGEXP_EXTRACT_ALL({Q.trimmed('message')}, '{T.ISSUE_REF}')) > 0 AS iss FROM commits QUALIFY ROW_NUMBER() OVER (PARTITION BY repo, pr_number, sha ORDER BY ingested_at DESC) = 1),
t AS (SELECT DISTINCT repo, pr_number, sha, UNNEST(files_touched) AS path FROM commits),
i AS (SELECT t.repo, t.pr_number, t.sha, SUM(COALESCE(fs.score, 0)) AS impact FROM t LEFT JOIN fs ON t.repo = fs.repo AND t.pr_number = fs.pr_number AND t.path = fs.path GROUP BY 1, 2, 3),
s AS (SELECT c.repo, c.pr_number, c.sha, ROUND(0.65::DOUBLE * COALESCE(impact, 0) + 0.35::DOUBLE * CASE WHEN iss THEN 1.5::DOUBLE ELSE 0 END, 6) AS score FROM c LEFT JOIN i USING (repo, pr_number, sha))
SELECT *, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY score DESC, sha)::INT AS place FROM s"""


def conditional_commits(spark: SparkSession, d: str) -> DataFrame:
    """R3 with the reference's numbers for commits: all of a PR if 8 at most, else the 6 best by M12."""
    return conditional_top(commit_scores(spark, d), ["repo", "pr_number"], [F.col("place")], 8, 6).select("repo", "pr_number", "sha")


CONDITIONAL_COMMITS_SQL = f"SELECT repo, pr_number, sha FROM ({COMMIT_SCORES_SQL}) QUALIFY COUNT(*) OVER (PARTITION BY repo, pr_number) <= 8 OR place <= 6"


def cleaned_patches(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned, combined and rendered patches of commits, as hashes and lengths."""
    return _cleaned(spark, d, 200)


def whole_patches(spark: SparkSession, d: str) -> DataFrame:
    """T9, T10, T11 as in the reference, where no patch is capped."""
    return _cleaned(spark, d, None)


def _cleaned(spark: SparkSession, d: str, max_lines: int | None) -> DataFrame:
    return table(spark, d, "commits").select(
        "sha", F.md5(T.combine_patches("patches", max_lines)).alias("combined"), F.length(T.render_diff("patches")).alias("rendered_chars"), F.md5(T.render_diff("patches")).alias("rendered")
    ).distinct()


_MARK = "CASE WHEN STARTS_WITH(x, ' ') THEN '<CTX> ' WHEN STARTS_WITH(x, '+') THEN '<ADD> ' ELSE '<DEL> ' END || SUBSTR(x, 2)"
_CLEAN = rf"[REGEXP_REPLACE(x, '\s+$', '') FOR x IN {Q.lines('p.patch')} IF NOT REGEXP_MATCHES(x, '^(diff --git a/.* b/.*|index .*|--- a/.*|\+\+\+ b/.*)$') AND TRIM(REGEXP_REPLACE(x, '\s', '', 'g')) <> ''][1:200]"
CLEANED_SQL = f"""WITH r AS (SELECT DISTINCT sha,
ARRAY_TO_STRING(STRING_SPLIT(ARRAY_TO_STRING([y FOR y IN [ARRAY_TO_STRING({_CLEAN}, CHR(10)) FOR p IN COALESCE(patches, [])] IF COALESCE(y, '') <> ''], CHR(10)), CHR(10))[1:200], CHR(10)) AS combined,
SUBSTR(ARRAY_TO_STRING(FLATTEN([(CASE WHEN COALESCE(p.filename, '') <> '' THEN ['<FILE> ' || p.filename] ELSE CAST([] AS VARCHAR[]) END) || [{_MARK} FOR x IN {Q.lines('p.patch')} IF NOT {Q._HEAD} AND (STARTS_WITH(x, ' ') OR STARTS_WITH(x, '+') OR STARTS_WITH(x, '-'))]
  FOR p IN COALESCE(patches, [])]), CHR(10)), 1, 40000) AS rendered FROM commits)
SELECT sha, MD5(combined) AS combined, LENGTH(rendered)::INT AS rendered_chars, MD5(rendered) AS rendered FROM r"""
WHOLE_SQL = CLEANED_SQL.replace("[1:200]", "")


def anchor_words(spark: SparkSession, d: str) -> DataFrame:
    """The first 5 identifiers that a patch adds."""
    return _files(spark, d).select("file_id", F.array_join(T.anchors("patch"), ",").alias("anchors")).distinct()


ANCHORS_SQL = f"""WITH f AS (SELECT DISTINCT file_id, patch FROM pr_files),
w AS (SELECT file_id, patch, [t FOR t IN FLATTEN([REGEXP_EXTRACT_ALL(x, '[A-Za-z_][A-Za-z0-9_]{{2,}}') FOR x IN {Q.lines('patch')} IF STARTS_WITH(x, '+')]) IF LOWER(t) NOT IN ({Q.q(T.ANCHOR_STOP)})] AS a FROM f),
dd AS (SELECT file_id, a, [a[i] FOR i IN RANGE(1, LEN(a) + 1) IF LIST_POSITION(a, a[i]) = i][1:5] AS k FROM w)
SELECT DISTINCT file_id, LOWER(ARRAY_TO_STRING(k, ',')) AS anchors FROM dd"""


def anchor_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most frequent anchor terms of each repository's messages, by count, length, text."""
    rows = table(spark, d, "commits").select("repo", "sha", T.anchor_terms("message").alias("t")).distinct()
    counts = rows.select("repo", F.explode("t").alias("term")).groupBy("repo", "term").count()
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("count"), F.length("term").desc(), "term"))
    return counts.withColumn("place", place).filter("place <= 5").select("repo", "term", F.col("count").alias("n"), "place")


ANCHOR_TERMS_SQL = """WITH r AS (SELECT DISTINCT repo, sha, REGEXP_EXTRACT_ALL(COALESCE(message, ''), '[A-Za-z_][A-Za-z0-9_./-]{2,}') AS t FROM commits),
e AS (SELECT repo, UNNEST(t) AS term FROM r), c AS (SELECT repo, term, COUNT(*) AS n FROM e WHERE REGEXP_MATCHES(term, '[a-z][A-Z]|[0-9_]|/') GROUP BY 1, 2)
SELECT repo, term, n, ROW_NUMBER() OVER (PARTITION BY repo ORDER BY n DESC, LENGTH(term) DESC, term)::INT AS place FROM c QUALIFY place <= 5"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Small text functions over messages."""
    return table(spark, d, "commits").select(
        "sha", T.slug("message").alias("slug"), F.round(T.length_score(F.length(T.trimmed("message"))), 6).alias("length_score"), F.round(T.specificity_score("message"), 6).alias("specificity"),
        T.clean_message_line("message").alias("line"), T.normalize_summary("message").alias("summary"), T.token_estimate("message").alias("tokens"),
    ).distinct()


MESSAGES_SQL = rf"""WITH m AS (SELECT DISTINCT sha, message, {Q.trimmed('message')} AS t, {Q.code_tokens('message')} AS k FROM commits),
s AS (SELECT *, REGEXP_REPLACE(REGEXP_REPLACE(LOWER(COALESCE(message, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl,
  REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(t, '(?i)^here\s+is[^:]*:\s*', ''), '^[#>*\-\s]+', ''), '#', '.') AS l FROM m)
SELECT DISTINCT sha, CASE WHEN sl = '' THEN 'mode' ELSE sl END AS slug, ROUND(GREATEST(0.0::DOUBLE, 1.0 - ABS(LENGTH(t) - 50) / 50.0::DOUBLE), 6) AS length_score,
ROUND(CASE WHEN LEN(k) = 0 THEN 0.0::DOUBLE ELSE LEAST(1.0::DOUBLE, LEN([x FOR x IN k IF {Q.ident('x')}]) / GREATEST(3, LEN(k))::DOUBLE) END, 6) AS specificity,
REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_SPLIT_TO_ARRAY(l, '\r\n|\r|\n')[1], '^\s+|\s+$', '', 'g'), '[.]+$', '') AS line,
TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(COALESCE(message, '')), '[`''"]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS summary,
GREATEST(1, LENGTH(COALESCE(message, '')) // 4)::INT AS tokens FROM s"""


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the tokens and bigrams of each message."""
    t, w = T.code_tokens("message"), T.word_tokens("message")
    return table(spark, d, "commits").select(
        "sha", F.array_join(t, " ").alias("code"), F.array_join(w, " ").alias("words"), F.array_join(T.expand_dotted(t), " ").alias("expanded"), F.size(F.array_distinct(T.ngrams(w, 2))).alias("bigrams")
    ).distinct()


TOKENS_SQL = f"""WITH m AS (SELECT DISTINCT sha, message, {Q.code_tokens('message')} AS t, {Q.word_tokens('message')} AS w FROM commits)
SELECT DISTINCT sha, ARRAY_TO_STRING(t, ' ') AS code, ARRAY_TO_STRING(w, ' ') AS words,
ARRAY_TO_STRING(FLATTEN([[y FOR y IN CASE WHEN CONTAINS(x, '.') THEN STRING_SPLIT(x, '.') WHEN CONTAINS(x, '#') THEN STRING_SPLIT(x, '#') WHEN CONTAINS(x, '::') THEN STRING_SPLIT(x, '::') ELSE [x] END IF y <> ''] FOR x IN t]), ' ') AS expanded,
LEN(LIST_DISTINCT([w[i] || ' ' || w[i + 1] FOR i IN RANGE(1, LEN(w))]))::INT AS bigrams FROM m"""


QUERIES = {
    "P4_P8_path_flags": (path_flags, PATH_FLAGS_SQL),
    "P9_missing_patch": (missing_patch, MISSING_SQL),
    "P10_ignored_counts": (ignored_counts, IGNORED_SQL),
    "T12_T13_diff_counts": (diff_counts, DIFF_COUNTS_SQL),
    "T14_T16_public_symbols": (public_symbols, PUBLIC_SQL),
    "M11_file_scores": (file_scores, FILE_SCORES_SQL),
    "R1_top_files": (top_files, TOP_FILES_SQL),
    "R1_top_files_25": (top_files_25, TOP_FILES_25_SQL),
    "R3_R4_conditional_top": (conditional_files, CONDITIONAL_SQL),
    "R3_R4_conditional_top_25": (conditional_files_25, CONDITIONAL_25_SQL),
    "R5_docs_top": (docs_top, DOCS_TOP_SQL),
    "R3_conditional_commits": (conditional_commits, CONDITIONAL_COMMITS_SQL),
    "R13_P3_head_cap": (head_cap, HEAD_CAP_SQL),
    "R13_P3_head_cap_200": (head_cap_200, HEAD_CAP_200_SQL),
    "T29_commit_annotations": (commit_annotations, ANNOTATIONS_SQL),
    "M6_message_quality": (message_quality, MESSAGE_QUALITY_SQL),
    "M12_R2_commit_scores": (commit_scores, COMMIT_SCORES_SQL),
    "T9_T11_patches": (cleaned_patches, CLEANED_SQL),
    "T9_T11_whole_patches": (whole_patches, WHOLE_SQL),
    "T19_anchors": (anchor_words, ANCHORS_SQL),
    "T20_A24_anchor_terms": (anchor_term_counts, ANCHOR_TERMS_SQL),
    "T8_T18_T21_T23_T31_messages": (messages, MESSAGES_SQL),
    "T1_T4_tokens": (token_rows, TOKENS_SQL),
}
