"""Queries over pipeline stages: decisions, prompts, answers, reports, streams' batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import paths as P
from tracewright.functions import text as T
from tracewright.operators import providers, rewrite, verdicts
from tracewright.operators.graph import commit_owner
from tracewright.operators.ranking import sample_head, sample_per_group, shuffled
from tracewright.operators.responses import lenient_object, parse_response
from tracewright.plans import sqlparts as Q
from tracewright.plans.evidence import conditional_commits
from tracewright.plans.judged import MODE_STATS_SQL, mode_score_stats
from tracewright.session import table
from tracewright.sources.sinks import report_rows
from tracewright.streaming.ingest import late_counts


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Commits with the prompt over their whole rendered diff; the best by M12 are rewritten, all of a PR if 8 at most, else 6."""
    keys = ["repo", "pr_number", "sha"]
    rows = table(spark, d, "commits").groupBy(*keys).agg(F.max_by(F.struct("message", "patches"), "ingested_at").alias("c")).select(*keys, "c.message", "c.patches")
    chosen = conditional_commits(spark, d).withColumn("ranked", F.lit(True))
    diff = rows.join(chosen, keys, "left").withColumns({"ranked": F.coalesce("ranked", F.lit(False)), "diff": T.render_diff("patches")}).drop("patches")
    return diff.withColumn("prompt", providers.rewrite_prompt(F.col("diff"), F.col("message"), F.array().cast("array<struct<message:string,diff:string>>")))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Commits with the offline provider's candidate; the prompt has no demonstrations (S4 is left out)."""
    answered = providers.call(_asked(spark, d), "rewrite", "prompt")
    return answered.withColumn("candidate", T.clean_message_line(lenient_object(F.col("answer"), "message string")["message"])).drop("prompt", "answer")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).withColumn("_ask", verdicts.verdict_prompt(F.col("message"), F.col("candidate"), F.coalesce("diff", F.lit("")), True))
    judged = providers.call(c, "verdict", "_ask", "_said", "offline_verdict")
    return rewrite.decide(judged.withColumn("_verdict", F.coalesce(verdicts.read_verdict(F.col("_said"), True), F.lit(False))), "message", "candidate", "diff", "ranked", "_verdict")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The fate of each commit message; the offline judge has the last word."""
    made = _decided(spark, d)
    return made.select("repo", "pr_number", "sha", "status", "reason")


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Commits with their decisions."""
    owner = commit_owner(table(spark, d, "commits")).select("sha", "repo", "pr_number")
    made = _decided(spark, d).join(owner, ["sha", "repo", "pr_number"])  # of a commit in several PRs the last one's
    commits = table(spark, d, "commits").select("sha", "message").distinct()
    return rewrite.merge_rewrites(commits, made).select("sha", "status", "reason", F.col("cmg_rewritten_message").isNotNull().alias("changed"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions read as answers of a model; what isn't JSON is the description itself."""
    g = table(spark, d, "generations").select("generation_id", parse_response(F.col("description")).alias("j"), providers.is_skipped(F.col("description")).alias("skipped"))
    return g.select("generation_id", F.length(F.from_json("j", "pr_description string")["pr_description"]).alias("chars"), "skipped").distinct()


ANSWERS_SQL = r"SELECT DISTINCT generation_id, CASE WHEN REGEXP_MATCHES(description, '^\s*\{') AND JSON_VALID(description) THEN LENGTH(JSON_EXTRACT_STRING(description, '$.pr_description')) ELSE LENGTH(REGEXP_REPLACE(description, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) END::INT AS chars, STARTS_WITH(COALESCE(description, ''), '[LLM skipped:') AS skipped FROM generations"


def rollups(spark: SparkSession, d: str) -> DataFrame:
    """Chunk judgments made of events, rolled up by user."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("chunk"), ((F.col("event_id") % 5) * 0.5).alias("correctness_penalty"), ((F.col("event_id") % 3) * 0.5).alias("coverage_penalty"), F.lit(None).cast("double").alias("clarity_penalty"), F.array("event_type").alias("correctness_penalties"), F.array().cast("array<string>").alias("coverage_penalties"), F.lit(None).cast("array<string>").alias("clarity_penalties"))
    r = rewrite.roll_up(e, ["user_id"])
    return r.select("user_id", "chunk_count", "correctness_penalty", "coverage_penalty", "clarity_penalty", F.array_join("correctness_penalties", ";").alias("notes"), F.size("clarity_penalties").alias("clarity_notes"))


ROLLUPS_SQL = """SELECT user_id, COUNT(*) AS chunk_count, MAX((event_id % 5) * 0.5::DOUBLE) AS correctness_penalty, MAX((event_id % 3) * 0.5::DOUBLE) AS coverage_penalty, 0.0::DOUBLE AS clarity_penalty,
STRING_AGG('[chunk ' || event_id || '] ' || event_type, ';' ORDER BY event_id) AS notes, 0 AS clarity_notes FROM events GROUP BY 1"""


def report(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of modes as a report's rows, three decimals."""
    return report_rows(mode_score_stats(spark, d), ["generation_mode", "n", "avg_generated", "avg_delta", "pref_rate"], 3)


REPORT_SQL = f"SELECT generation_mode, n, PRINTF('%.3f', avg_generated) AS avg_generated, PRINTF('%.3f', avg_delta) AS avg_delta, PRINTF('%.3f', pref_rate) AS pref_rate FROM ({MODE_STATS_SQL})"


def whole_commit_evidence(spark: SparkSession, d: str) -> DataFrame:
    """All commits of a PR if 15 at most, in their order, else 25: those with documents, those that
    change public symbols, then the longest; in the end by length. A diff's length counts its first 50 lines."""
    rows = table(spark, d, "commits").groupBy("repo", "pr_number", "sha").agg(F.max_by(F.coalesce("patches", F.array()), "ingested_at").alias("ps"))
    lines = F.aggregate("ps", F.lit(0), lambda s, p: s + F.size(T.changed_lines(p["patch"])) + F.when(F.coalesce(p["filename"], F.lit("")) != "", 1).otherwise(0))
    public = F.exists("ps", lambda p: P.public_symbols(p["filename"], T.added_lines(p["patch"])) + P.public_symbols(p["filename"], T.removed_lines(p["patch"])) > 0)
    docs = F.exists("ps", lambda p: F.coalesce(P.is_docs(p["filename"]), F.lit(False)))
    classed = rows.select("repo", "pr_number", "sha", F.when(docs, 0).when(public, 1).otherwise(2).alias("class"), F.least(lines, F.lit(50)).alias("n"))
    pr = Window.partitionBy("repo", "pr_number")
    ranked = classed.withColumns({"of": F.count("*").over(pr), "p": F.row_number().over(pr.orderBy("class", F.when(F.col("class") == 2, -F.col("n")), "sha"))})
    kept = ranked.filter("of <= 15 OR p <= 25")
    return kept.select("repo", "pr_number", "sha", F.row_number().over(pr.orderBy(F.when(F.col("of") > 15, -F.col("n")), F.when(F.col("of") > 15, F.col("p")), "sha")).alias("place"))


_PUBLIC = " + ".join(
    f"COALESCE(CASE {Q.language('p.filename')} " + " ".join(f"WHEN '{k}' THEN LEN([y FOR y IN {Q.changed('p.patch', sign)} IF REGEXP_MATCHES(y, '{r}')])" for k, r in P.PUBLIC.items()) + " END, 0)" for sign in "+-"
)
WHOLE_EVIDENCE_SQL = f"""WITH c AS (SELECT repo, pr_number, sha, COALESCE(patches, []) AS ps FROM commits QUALIFY ROW_NUMBER() OVER (PARTITION BY repo, pr_number, sha ORDER BY ingested_at DESC) = 1),
k AS (SELECT repo, pr_number, sha, CASE WHEN LEN([1 FOR p IN ps IF COALESCE({Q.is_docs('p.filename')}, FALSE)]) > 0 THEN 0 WHEN COALESCE(LIST_SUM([{_PUBLIC} FOR p IN ps]), 0) > 0 THEN 1 ELSE 2 END AS class,
  LEAST(50, COALESCE(LIST_SUM([LEN({Q.both('p.patch')}) + CASE WHEN COALESCE(p.filename, '') <> '' THEN 1 ELSE 0 END FOR p IN ps]), 0)) AS n FROM c),
r AS (SELECT *, COUNT(*) OVER (PARTITION BY repo, pr_number) AS of_, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY class, CASE WHEN class = 2 THEN -n END, sha) AS p FROM k),
f AS (SELECT * FROM r WHERE of_ <= 15 OR p <= 25)
SELECT repo, pr_number, sha, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY CASE WHEN of_ > 15 THEN -n END, CASE WHEN of_ > 15 THEN p END, sha)::INT AS place FROM f"""


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of ten PRs."""
    return sample_head(table(spark, d, "pull_requests").select("repo", "number").distinct(), ["repo", "number"], 10, 42)


SAMPLE_SQL = "SELECT * FROM (SELECT DISTINCT repo, number FROM pull_requests) ORDER BY MD5(repo || '|' || number || '|42') LIMIT 10"


def survey_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten PRs of each language's repositories, and for each a random assignment of its five versions to the letters A to E."""
    prs = table(spark, d, "pull_requests").select("repo", "number").distinct()
    names = table(spark, d, "repos").select(F.col("full_name").alias("repo"), F.coalesce("language", F.lit("other")).alias("dataset")).distinct()
    some = sample_per_group(prs.join(F.broadcast(names), "repo"), ["dataset"], ["repo", "number"], 10, 7).drop("place")  # a row per repository
    version = some.select("*", F.explode(F.array(*[F.lit(x) for x in VERSIONS])).alias("version"))
    letter = F.row_number().over(Window.partitionBy("dataset", "repo", "number").orderBy(shuffled(["repo", "number", "version"], 9)))
    return version.withColumn("letter", F.substring(F.lit("ABCDE"), letter, F.lit(1)))


SURVEY_SAMPLE_SQL = """WITH p AS (SELECT DISTINCT repo, number FROM pull_requests), n AS (SELECT DISTINCT full_name AS repo, COALESCE(language, 'other') AS dataset FROM repos),
s AS (SELECT repo, number, dataset FROM p JOIN n USING (repo) QUALIFY ROW_NUMBER() OVER (PARTITION BY dataset ORDER BY MD5(repo || '|' || number || '|7'), repo, number) <= 10),
v AS (SELECT *, UNNEST(['original', 'raw', 'cmg_only', 'file_summaries_only', 'full']) AS version FROM s)
SELECT repo, number, dataset, version, SUBSTR('ABCDE', ROW_NUMBER() OVER (PARTITION BY dataset, repo, number ORDER BY MD5(repo || '|' || number || '|' || version || '|9'))::INT, 1) AS letter FROM v"""
VERSIONS = ("original", "raw", "cmg_only", "file_summaries_only", "full")


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions without their markdown, as hashes."""
    return table(spark, d, "generations").select("generation_id", F.md5(T.clean_markdown("description")).alias("clean")).distinct()


_INNER = rf"REGEXP_REPLACE(REGEXP_REPLACE({Q.trimmed('description')}, '\A```\w*\n?', ''), '^\s+|\s+$', '', 'g')"
_INNER2 = rf"REGEXP_REPLACE(REGEXP_REPLACE({_INNER}, '\n?```\z', ''), '^\s+|\s+$', '', 'g')"
_BARE = r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(x, '^\s*[-*•+]\s*', ''), '^#+\s*', ''), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '^\s+|\s+$', '', 'g')"
MARKDOWN_SQL = rf"WITH g AS (SELECT DISTINCT generation_id, {_INNER2} AS inner_ FROM generations) SELECT generation_id, MD5(REGEXP_REPLACE(ARRAY_TO_STRING([{_BARE} FOR x IN {Q.lines('inner_')}], CHR(10)), '^\s+|\s+$', '', 'g')) AS clean FROM g"


def names(spark: SparkSession, d: str) -> DataFrame:
    """Dataset from a name and rank from a text, over the titles of PRs."""
    f = F.concat_ws("-", F.when(F.col("number") % 3 == 0, "x_AIDev").when(F.col("number") % 3 == 1, "parsed").otherwise("zz"), F.col("number").cast("string"))
    return table(spark, d, "pull_requests").select("node_id", T.dataset_of_file(f).alias("dataset"), T.parse_rank(F.concat(F.lit(" "), F.col("number").cast("string"), F.lit(" (best)"))).alias("rank")).distinct()


NAMES_SQL = r"SELECT DISTINCT node_id, CASE number % 3 WHEN 0 THEN 'aidev' WHEN 1 THEN 'prsummarizer' ELSE 'unknown' END AS dataset, TRY_CAST(REGEXP_EXTRACT(CAST(number AS VARCHAR), '^([1-5])', 1) AS INT) AS rank FROM pull_requests"


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: events by hour and type; the same plan runs on a stream with a watermark."""
    w = late_counts(table(spark, d, "events"))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


WINDOWS_SQL = "SELECT CAST(FLOOR(EPOCH(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2"

QUERIES = {
    "M21_decisions": (decisions, None),
    "J9_merged": (merged, None),
    "N3_answers": (answers, ANSWERS_SQL),
    "A23_rollups": (rollups, ROLLUPS_SQL),
    "K5_T32_report": (report, REPORT_SQL),
    "R7_whole_commit_evidence": (whole_commit_evidence, WHOLE_EVIDENCE_SQL),
    "R11_sample": (sampled, SAMPLE_SQL),
    "L24_survey_sample": (survey_sample, SURVEY_SAMPLE_SQL),
    "T22_markdown": (markdown, MARKDOWN_SQL),
    "T26_T28_names": (names, NAMES_SQL),
    "X1_windows": (windows, WINDOWS_SQL),
}
