"""Queries over nested contexts, judged exports, verdicts and file summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import paths as P
from tracewright.functions import text as T
from tracewright.operators import chunking, providers, verdicts
from tracewright.plans import sqlparts as Q
from tracewright.session import table

NO_PATCH = "[Patch not available]"
VERSIONS = ("raw", "cmg_only", "file_summaries_only", "full")


def pr_commits(spark: SparkSession, d: str) -> DataFrame:
    """The commits of each PR with their node's attributes; missing lists count as empty."""
    last = F.max_by(F.struct("message", "author_login", F.coalesce("files_touched", F.array()).alias("files"), F.coalesce("patches", F.array()).alias("patches")), "ingested_at").alias("c")
    rows = table(spark, d, "commits").groupBy("repo", "pr_number", "sha").agg(last, F.min("ingested_at").alias("first"))
    return rows.select("repo", "pr_number", "sha", "first", "c.message", "c.author_login", F.size("c.files").alias("files"), F.size("c.patches").alias("patches"))


_COMMITS_SQL = """jc AS (SELECT repo, pr_number, sha, MIN(ingested_at) AS first, ARG_MAX({'m': message, 'a': author_login, 'f': LEN(COALESCE(files_touched, [])), 'p': LEN(COALESCE(patches, []))}, ingested_at) AS c FROM commits GROUP BY 1, 2, 3)"""
PR_COMMITS_SQL = f"WITH {_COMMITS_SQL} SELECT repo, pr_number, sha, c.m AS message, c.a AS author_login, c.f::INT AS files, c.p::INT AS patches FROM jc"


def pr_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of each PR with what their edge holds; a null patch reads as the placeholder. The patch itself stays behind: its length and hash go on."""
    patch = F.coalesce("patch", F.lit(NO_PATCH))
    rows = table(spark, d, "pr_files").select("repo", "pr_number", "file_id", "ingested_at", F.col("path").alias("filename"), "status", "additions", "deletions", "changes", F.md5(patch).alias("digest"), F.length(patch).alias("chars"), P.is_docs("path").alias("is_docs"), F.coalesce(F.col("patch") != "", F.lit(False)).alias("has_patch"))
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("file_id", "ingested_at")]), "ingested_at").alias("f")
    return rows.groupBy("file_id").agg(last).select("file_id", "f.*")


_FILES_SQL = f"""jf AS (SELECT file_id, repo, pr_number, path AS filename, status, additions, deletions, changes, MD5(COALESCE(patch, '{NO_PATCH}')) AS digest, LENGTH(COALESCE(patch, '{NO_PATCH}'))::INT AS chars, {Q.is_docs('path')} AS is_docs, COALESCE(patch <> '', FALSE) AS has_patch
  FROM pr_files QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1)"""
PR_FILES_SQL = f"WITH {_FILES_SQL} SELECT * FROM jf"


def pr_issues(spark: SparkSession, d: str) -> DataFrame:
    """The issues of each PR; keyword and origin of the edge stand in place of the node's."""
    rank = F.when(F.col("source") == "regex", 0).otherwise(1)
    rows = table(spark, d, "issues").select("repo", "pr_number", "number", "source", "keyword_used", "title", "state", F.length("body").alias("body_chars"))
    best = F.min(F.struct(rank.alias("k"), "source", "keyword_used", "title", "state", "body_chars")).alias("i")
    return rows.groupBy("repo", "pr_number", "number").agg(best).select("repo", "pr_number", "number", "i.source", "i.keyword_used", "i.title", "i.state", "i.body_chars")


_ISSUES_SQL = """ji AS (SELECT repo, pr_number, number, source, keyword_used, title, state, LENGTH(body)::INT AS body_chars FROM issues
  QUALIFY ROW_NUMBER() OVER (PARTITION BY repo, pr_number, number ORDER BY CASE WHEN source = 'regex' THEN 0 ELSE 1 END, source NULLS FIRST, keyword_used NULLS FIRST, title NULLS FIRST, state NULLS FIRST, LENGTH(body) NULLS FIRST) = 1)"""
PR_ISSUES_SQL = f"WITH {_ISSUES_SQL} SELECT * FROM ji"


def pr_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A row per PR with its repository and nested, ordered issues, commits and files; nulls go out of the JSON."""
    prs = table(spark, d, "pull_requests").groupBy("repo", F.col("number").alias("pr_number")).agg(F.max_by(F.struct("title", "state"), "ingested_at").alias("pr"))
    repos = table(spark, d, "repos").groupBy(F.col("full_name").alias("repo")).agg(F.struct(F.min("language").alias("language"), F.max("stars").alias("stars")).alias("repository"))
    gather = lambda df, order, *fields: df.groupBy("repo", "pr_number").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("a"))
    issues = gather(pr_issues(spark, d), ["number"], "title", "state", "source", "keyword_used", "body_chars").withColumnRenamed("a", "linked_issues")
    commits = gather(pr_commits(spark, d), ["first", "sha"], "message", "author_login").withColumnRenamed("a", "commits")
    files = gather(pr_files(spark, d), ["file_id"], "filename", "status", "additions", "deletions", "changes", "is_docs", "chars").withColumnRenamed("a", "files")
    out = prs.join(repos, "repo", "left")
    for part in (issues, commits, files):
        out = out.join(part, ["repo", "pr_number"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: empty(c) for c in ("linked_issues", "commits", "files")})


def context_rows(spark: SparkSession, d: str) -> DataFrame:
    """The contexts as JSON texts, read again and taken apart."""
    c = pr_contexts(spark, d)
    kind = c.drop("repo", "pr_number").schema.simpleString()
    read = c.select("repo", "pr_number", F.from_json(F.to_json(F.struct("pr", "repository", "linked_issues", "commits", "files")), kind).alias("j"))
    part = lambda name, key, of: F.transform(F.col(f"j.{name}"), lambda x, i: F.struct(F.lit(name).alias("part"), i.alias("pos"), key(x).cast("string").alias("key"), F.md5(F.concat_ws("|", *of(x))).alias("digest")))
    parts = F.concat(
        F.array(F.struct(F.lit("pr").alias("part"), F.lit(0).alias("pos"), F.col("j.pr.title").alias("key"), F.md5(F.concat_ws("|", "j.pr.state", "j.repository.language", F.col("j.repository.stars").cast("string"))).alias("digest"))),
        part("linked_issues", lambda x: x["number"], lambda x: (x["title"], x["state"], x["source"], x["keyword_used"])),
        part("commits", lambda x: x["sha"], lambda x: (x["message"], x["author_login"])),
        part("files", lambda x: x["filename"], lambda x: (x["status"], x["additions"].cast("string"), x["deletions"].cast("string"), x["changes"].cast("string"), x["chars"].cast("string"))),
    )
    return read.select("repo", "pr_number", F.explode(parts).alias("x")).select("repo", "pr_number", "x.part", "x.pos", "x.key", "x.digest")


CONTEXT_ROWS_SQL = f"""WITH {_COMMITS_SQL}, {_FILES_SQL}, {_ISSUES_SQL}, jp AS (SELECT repo, number AS pr_number, ARG_MAX({{'t': title, 's': state}}, ingested_at) AS pr FROM pull_requests GROUP BY 1, 2), jr AS (SELECT full_name, MIN(language) AS language, MAX(stars) AS stars FROM repos GROUP BY 1)
SELECT repo, pr_number, 'pr' AS part, 0 AS pos, pr.t AS key, MD5(CONCAT_WS('|', pr.s, language, CAST(stars AS VARCHAR))) AS digest FROM jp LEFT JOIN jr ON full_name = repo
UNION ALL SELECT repo, pr_number, 'linked_issues', (ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY number) - 1)::INT, CAST(number AS VARCHAR), MD5(CONCAT_WS('|', title, state, source, keyword_used)) FROM ji SEMI JOIN jp USING (repo, pr_number)
UNION ALL SELECT repo, pr_number, 'commits', (ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY first, sha) - 1)::INT, sha, MD5(CONCAT_WS('|', c.m, c.a)) FROM jc SEMI JOIN jp USING (repo, pr_number)
UNION ALL SELECT repo, pr_number, 'files', (ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY file_id) - 1)::INT, filename, MD5(CONCAT_WS('|', status, CAST(additions AS VARCHAR), CAST(deletions AS VARCHAR), CAST(changes AS VARCHAR), CAST(chars AS VARCHAR))) FROM jf SEMI JOIN jp USING (repo, pr_number)"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The judge's prompt of each description with the evidence of its PR; length, and the places of its parts."""
    g = table(spark, d, "generations").groupBy("generation_id").agg(F.max_by(F.struct("repo_name", "pr_number", "description", "file_summaries"), "ingested_at").alias("g")).select("generation_id", F.col("g.repo_name").alias("repo"), "g.pr_number", "g.description", "g.file_summaries")
    rows = g.join(pr_contexts(spark, d), ["repo", "pr_number"])
    listed = F.transform("files", lambda x: F.struct(x["filename"].alias("filename"), x["status"].alias("status"), x["additions"].alias("additions"), x["deletions"].alias("deletions")))
    said = F.transform("commits", lambda x: F.struct(x["sha"].alias("sha"), x["message"].alias("message")))
    meta = F.struct(F.size("files").alias("total_files"), F.size("files").alias("returned_files"), F.lit(False).alias("truncated"))
    prompt = providers.judge_prompt(F.col("description"), {"files": listed, "meta": meta, "messages": said, "summaries": F.col("file_summaries"), "issues": F.col("linked_issues")})
    asked = rows.select("generation_id", prompt.alias("p"), F.col("description"))
    return asked.select(
        "generation_id", (F.instr("p", "Files:") == 1).alias("opens"), F.contains("p", F.trim(F.coalesce("description", F.lit("")))).alias("holds"),
        F.regexp_extract("p", r"total_files\":(\d+)", 1).cast("int").alias("total_files"), F.endswith("p", F.lit("no text outside of it.")).alias("ends"),
    )


PROMPTS_SQL = f"""WITH {_FILES_SQL}, g AS (SELECT generation_id, ARG_MAX({{'r': repo_name, 'n': pr_number}}, ingested_at) AS g FROM generations GROUP BY 1), n AS (SELECT repo, pr_number, COUNT(*) AS n FROM jf GROUP BY 1, 2), p AS (SELECT DISTINCT repo, number FROM pull_requests)
SELECT generation_id, TRUE AS opens, TRUE AS holds, COALESCE(n.n, 0)::INT AS total_files, TRUE AS ends FROM g JOIN p ON p.repo = g.g.r AND p.number = g.g.n LEFT JOIN n ON n.repo = p.repo AND n.pr_number = p.number"""


def _dataset(name: Column) -> Column:
    """The dataset in an export's file name, as much of it as fits."""
    found = F.regexp_extract(name, r"(?i)descriptions-([a-z0-9_-]+)-", 1)
    return F.when(found == "", "dataset").otherwise(found)


def judged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Judged descriptions made of generations: scores and penalties follow from the id."""
    i = F.col("generation_id")
    rows = table(spark, d, "generations").groupBy("generation_id").agg(F.max_by(F.struct("repo_name", "pr_number", "generation_mode", "description", "prompt"), "ingested_at").alias("g")).select("generation_id", "g.*")
    a, b, c = (i % 3) * 0.5, (i % 4) * 0.5, (i % 2) * 0.5
    texts = F.concat(F.when(a > 0, F.array(F.lit("unsupported claim"))).otherwise(F.array().cast("array<string>")), F.when(b > 0, F.array(F.lit("missing key change"))).otherwise(F.array().cast("array<string>")))
    reason = F.when(F.greatest(a, b, c) <= 0, F.lit(None)).when(a == F.greatest(a, b, c), "correctness").when(b == F.greatest(a, b, c), "coverage").otherwise("clarity")
    file = F.concat(F.lit("descriptions-AIDev_"), F.col("generation_mode"), F.lit("-"), (i % 2).cast("string"), F.lit("-x.json"))
    return rows.select(
        "generation_id", "repo_name", "pr_number", F.lower(F.trim(F.coalesce("generation_mode", F.lit("")))).alias("mode"), _dataset(file).alias("dataset"), "description", F.substring_index("prompt", "\n", 1).alias("original_description"),
        (5.0 - (a + b + c)).alias("score"), a.alias("correctness_penalty"), b.alias("coverage_penalty"), c.alias("clarity_penalty"), reason.alias("primary_reason"), texts.alias("penalties"),
    )


def survey_export(spark: SparkSession, d: str) -> DataFrame:
    """One JSON text per PR: the original from its first row, and of each mode the first row, eight fields each."""
    rows = judged_rows(spark, d).filter("repo_name IS NOT NULL AND pr_number IS NOT NULL")
    quoted = F.when(F.size("penalties") == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join("penalties", '", "'), F.lit('"]')))
    cell = F.struct(F.col("mode"), "description", "score", "correctness_penalty", "coverage_penalty", "clarity_penalty", "primary_reason", quoted.alias("penalties"))
    own = F.struct(F.lit("original").alias("mode"), F.col("original_description").alias("description"), F.lit(3.0).alias("score"), F.lit(0.5).alias("correctness_penalty"), F.lit(0.5).alias("coverage_penalty"), F.lit(1.0).alias("clarity_penalty"), F.lit("clarity").alias("primary_reason"), F.lit("[]").alias("penalties"))
    first = [F.min_by(cell, F.when(F.col("mode") == m, F.col("generation_id"))).alias(f"generated_{m}") for m in VERSIONS]
    docs = rows.groupBy("repo_name", "pr_number").agg(F.min("generation_id").alias("ord"), F.min_by(own, "generation_id").alias("original"), *[F.when(F.count_if(F.col("mode") == m) > 0, x).alias(f"generated_{m}") for m, x in zip(VERSIONS, first)])
    return docs.select("repo_name", "pr_number", "ord", F.to_json(F.struct("repo_name", "pr_number", "original", *[f"generated_{m}" for m in VERSIONS])).alias("json"))


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The export read again, a row per PR and version."""
    cell = "struct<mode:string,description:string,score:double,correctness_penalty:double,coverage_penalty:double,clarity_penalty:double,primary_reason:string,penalties:string>"
    names = ["original", *[f"generated_{m}" for m in VERSIONS]]
    read = survey_export(spark, d).select("repo_name", "pr_number", "ord", F.from_json("json", "struct<" + ",".join(f"{n}:{cell}" for n in names) + ">").alias("j"))
    return read.select("repo_name", "pr_number", "ord", F.explode(F.filter(F.array(*[F.col(f"j.{n}") for n in names]), lambda x: x.isNotNull())).alias("v")).select(
        "repo_name", "pr_number", "ord", "v.mode", F.md5(F.coalesce("v.description", F.lit(""))).alias("digest"), "v.score", "v.correctness_penalty", "v.coverage_penalty", "v.clarity_penalty", "v.primary_reason", "v.penalties"
    )


_JUDGED_SQL = """g0 AS (SELECT generation_id AS i, ARG_MAX({'r': repo_name, 'n': pr_number, 'm': generation_mode, 'd': description, 'p': prompt}, ingested_at) AS g FROM generations GROUP BY 1),
j AS (SELECT i, g.r AS repo_name, g.n AS pr_number, LOWER(TRIM(g.m)) AS mode, g.d AS description, SPLIT_PART(g.p, CHR(10), 1) AS original, (i % 3) * 0.5::DOUBLE AS a, (i % 4) * 0.5::DOUBLE AS b, (i % 2) * 0.5::DOUBLE AS c FROM g0),
k AS (SELECT *, 5.0::DOUBLE - (a + b + c) AS score, CASE WHEN GREATEST(a, b, c) <= 0 THEN NULL WHEN a = GREATEST(a, b, c) THEN 'correctness' WHEN b = GREATEST(a, b, c) THEN 'coverage' ELSE 'clarity' END AS reason,
  CASE WHEN a > 0 AND b > 0 THEN '["unsupported claim", "missing key change"]' WHEN a > 0 THEN '["unsupported claim"]' WHEN b > 0 THEN '["missing key change"]' ELSE '[]' END AS penalties FROM j),
f AS (SELECT repo_name, pr_number, MIN(i) AS ord, ARG_MIN(original, i) AS original FROM j GROUP BY 1, 2)"""
EXPORT_SQL = f"""WITH {_JUDGED_SQL}, m AS (SELECT * FROM k WHERE mode IN ('raw', 'cmg_only', 'file_summaries_only', 'full') QUALIFY ROW_NUMBER() OVER (PARTITION BY repo_name, pr_number, mode ORDER BY i) = 1)
SELECT repo_name, pr_number, ord, 'original' AS mode, MD5(COALESCE(original, '')) AS digest, 3.0::DOUBLE AS score, 0.5::DOUBLE AS correctness_penalty, 0.5::DOUBLE AS coverage_penalty, 1.0::DOUBLE AS clarity_penalty, 'clarity' AS primary_reason, '[]' AS penalties FROM f
UNION ALL SELECT m.repo_name, m.pr_number, ord, mode, MD5(COALESCE(description, '')), score, a, b, c, reason, penalties FROM m JOIN f ON m.repo_name = f.repo_name AND m.pr_number = f.pr_number"""


def export_names(spark: SparkSession, d: str) -> DataFrame:
    """The dataset of each judged row's file, and its mode's key."""
    return judged_rows(spark, d).select("generation_id", "dataset", "mode")


EXPORT_NAMES_SQL = """SELECT DISTINCT generation_id, 'AIDev_' || generation_mode || '-' || (generation_id % 2) AS dataset, LOWER(TRIM(generation_mode)) AS mode FROM generations"""


def rounded_maps(spark: SparkSession, d: str) -> DataFrame:
    """Values of a map to four decimals."""
    rows = table(spark, d, "generations").groupBy("generation_id").agg(F.max("duration_seconds").alias("s"), F.max(F.length("prompt")).alias("n"))
    scores = F.create_map(F.lit("minutes"), F.col("s") / 60, F.lit("pages"), F.col("n") / F.lit(1800.0))
    return rows.select("generation_id", F.explode(F.transform_values(scores, lambda k, v: F.round(v, 4))).alias("name", "value"))


ROUNDED_SQL = """WITH r AS (SELECT generation_id, MAX(duration_seconds) AS s, MAX(LENGTH(prompt)) AS n FROM generations GROUP BY 1)
SELECT generation_id, 'minutes' AS name, ROUND(s / 60, 4) AS value FROM r UNION ALL SELECT generation_id, 'pages', ROUND(n / 1800.0::DOUBLE, 4) FROM r"""


def single_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the offline judge says of each commit's message against its author's name, in both ways of asking; every ninth answer is noise."""
    rows = table(spark, d, "commits").groupBy("sha").agg(F.max_by(F.struct("message", "author", F.array_join("files_touched", " ").alias("diff")), F.struct("ingested_at", "repo", "pr_number")).alias("c")).select("sha", "c.*")
    out = rows
    for name, pairwise in (("pairwise", True), ("binary", False)):
        asked = out.withColumn("prompt", verdicts.verdict_prompt(F.col("message"), F.col("author"), F.coalesce("diff", F.lit("")), pairwise))
        answered = providers.call(asked, "verdict", "prompt", f"{name}_answer", "offline_verdict")
        noise = F.when(F.pmod(F.conv(F.substring("sha", 1, 4), 16, 10).cast("int"), F.lit(9)) == 0, F.lit("maybe")).otherwise(F.concat(F.lit(" "), F.lower(f"{name}_answer")))
        out = answered.withColumn(name, verdicts.read_verdict(noise, pairwise)).drop("prompt", f"{name}_answer")
    return out.select("sha", "pairwise", "binary")


def _asked_sql(first: str, second: str, ask: str) -> str:
    return f"SUBSTR(MD5('Diff:' || CHR(10) || SUBSTR(COALESCE(c.d, ''), 1, 1500) || CHR(10) || CHR(10) || '{first}' || COALESCE(c.m, '') || CHR(10) || CHR(10) || '{second}' || COALESCE(c.a, '') || CHR(10) || CHR(10) || '{ask}'), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')"


SINGLE_VERDICTS_SQL = f"""WITH c AS (SELECT sha, ARG_MAX({{'m': message, 'a': author, 'd': ARRAY_TO_STRING(files_touched, ' ')}}, (ingested_at, repo, pr_number)) AS c FROM commits GROUP BY 1)
SELECT sha, CASE WHEN CAST('0x' || SUBSTR(sha, 1, 4) AS INT) % 9 <> 0 THEN {_asked_sql('A: ', 'B: ', 'Which message tells the change better, A or B? Answer with one letter.')} END AS pairwise,
CASE WHEN CAST('0x' || SUBSTR(sha, 1, 4) AS INT) % 9 <> 0 THEN {_asked_sql('Original: ', 'New: ', 'Is the new message clearly better? Answer YES or NO.')} END AS "binary" FROM c"""


def batch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts read out of one answer for all commits of a PR; commits without an entry, and those of an answer that is no array, are rejected; with the judge off all pass."""
    x = F.expr("try_cast(conv(substring(sha, 1, 4), 16, 10) AS int)")
    rows = table(spark, d, "commits").select("repo", "pr_number", "sha", x.alias("x")).distinct()
    entry = F.when(F.col("x") % 5 > 0, F.struct("sha", (F.col("x") % 2 == 0).alias("accept"), F.when(F.col("x") % 3 == 0, "candidate").otherwise("original").alias("winner")))
    answers = rows.groupBy("repo", "pr_number").agg(F.array_sort(F.collect_list(entry)).alias("e")).withColumn("answer", F.when(F.col("pr_number") % 7 == 0, "I could not decide.").otherwise(F.concat(F.lit("Sure:\n"), F.to_json("e"))))
    both = rows.join(answers, ["repo", "pr_number"])
    return both.select("repo", "pr_number", "sha", verdicts.read_batch(F.col("answer"), F.col("sha"), False).alias("binary"), verdicts.read_batch(F.col("answer"), F.col("sha"), True).alias("pairwise"), verdicts.read_batch(F.col("answer"), F.col("sha"), True, False).alias("disabled"))


BATCH_VERDICTS_SQL = """WITH r AS (SELECT DISTINCT repo, pr_number, sha, CAST('0x' || SUBSTR(sha, 1, 4) AS INT) AS x FROM commits)
SELECT repo, pr_number, sha, pr_number % 7 <> 0 AND x % 5 > 0 AND x % 2 = 0 AS "binary", pr_number % 7 <> 0 AND x % 5 > 0 AND x % 3 = 0 AS pairwise, TRUE AS disabled FROM r"""


def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the files of a PR in batches of three; where a batch's answer is no array, file by file."""
    rows = table(spark, d, "pr_files").select("repo", "pr_number", F.col("path").alias("filename"), F.concat_ws(" ", F.lit("the change of"), "path", F.lit("in words")).alias("diff")).filter("filename IS NOT NULL").distinct()
    batched = chunking.batches(rows, ["repo", "pr_number"], ["filename"], 3)
    return verdicts.summarise_files(batched, ["repo", "pr_number"], 3).select("repo", "pr_number", "batch", "filename", "summary", "by")


FILE_SUMMARIES_SQL = """WITH f AS (SELECT DISTINCT repo, pr_number, path AS filename FROM pr_files WHERE path IS NOT NULL), b AS (SELECT *, ((ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY filename) - 1) // 3)::INT AS batch FROM f),
p AS (SELECT repo, pr_number, batch, STRING_AGG('File: ' || filename || CHR(10) || 'the change of ' || filename || ' in words', CHR(10) || '---' || CHR(10) ORDER BY filename) AS prompt FROM b GROUP BY 1, 2, 3)
SELECT b.repo, b.pr_number, b.batch, b.filename, ARRAY_TO_STRING(LIST_SLICE(REGEXP_SPLIT_TO_ARRAY('the change of ' || b.filename || ' in words', ' +'), 1, 5), ' ') AS summary,
CASE WHEN SUBSTR(MD5(prompt), 1, 1) IN ('0', '4', '8', 'c') THEN 'file' ELSE 'batch' END AS by FROM b JOIN p USING (repo, pr_number, batch)"""


def dataset_labels(spark: SparkSession, d: str) -> DataFrame:
    """The dataset of a name whatever its case, and its label; unknown names stay as they are, in lower case."""
    alias = F.create_map(*[F.lit(x) for x in ("parsed", "prsummarizer", "trudeau", "prsummarizer", "prsummarizer", "prsummarizer", "aidev", "aidev")])
    label = F.create_map(*[F.lit(x) for x in ("aidev", "AIDev", "prsummarizer", "PRSummarizer")])
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Parsed", "TRUDEAU", "aidev", "AIDev", "Other")]), (F.col("number") % 5 + 1).cast("int"))
    rows = table(spark, d, "pull_requests").select("node_id", F.lower(raw).alias("low")).distinct().select("node_id", F.coalesce(alias[F.col("low")], F.col("low")).alias("dataset"))
    return rows.select("node_id", "dataset", F.coalesce(label[F.col("dataset")], F.col("dataset")).alias("label"))


LABELS_SQL = "SELECT DISTINCT node_id, ['prsummarizer', 'prsummarizer', 'aidev', 'aidev', 'other'][number % 5 + 1] AS dataset, ['PRSummarizer', 'PRSummarizer', 'AIDev', 'AIDev', 'other'][number % 5 + 1] AS label FROM pull_requests"

QUERIES = {
    "J1_pr_commits": (lambda s, d: pr_commits(s, d).drop("first"), PR_COMMITS_SQL),
    "J2_P3_pr_files": (pr_files, PR_FILES_SQL),
    "J3_pr_issues": (pr_issues, PR_ISSUES_SQL),
    "N8_pr_contexts": (context_rows, CONTEXT_ROWS_SQL),
    "L12_L14_L15_prompts": (prompts, PROMPTS_SQL),
    "N9_N10_K6_L17_export": (export_rows, EXPORT_SQL),
    "L18_export_names": (export_names, EXPORT_NAMES_SQL),
    "N7_rounded_maps": (rounded_maps, ROUNDED_SQL),
    "L9_verdicts": (single_verdicts, SINGLE_VERDICTS_SQL),
    "L8_batch_verdicts": (batch_verdicts, BATCH_VERDICTS_SQL),
    "L10_file_summaries": (file_summaries, FILE_SUMMARIES_SQL),
    "T27_labels": (dataset_labels, LABELS_SQL),
}
