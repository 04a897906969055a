"""Queries over judged descriptions: statistics by mode, winners, deltas, penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import scores as S
from tracewright.functions import text as T
from tracewright.operators import aggregates as A
from tracewright.operators.dedupe import first, latest
from tracewright.session import table

REQUIRED = ("raw", "cmg_only", "file_summaries_only", "full")

#: Judged rows made of the events: a PR is a user in a week, a mode an event type; each event costs half a point.
JUDGED_SQL = """cell AS (
  SELECT CAST(user_id AS VARCHAR) AS repo_name, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS INT) AS pr_number,
    CASE event_type WHEN 'view' THEN 'raw' WHEN 'click' THEN 'cmg_only' WHEN 'signup' THEN 'file_summaries_only' WHEN 'purchase' THEN 'full' ELSE 'original' END AS generation_mode,
    MIN(event_id) AS ord, GREATEST(1.0::DOUBLE, 5.0::DOUBLE - 0.5::DOUBLE * COUNT(*)) AS score,
    LEAST(2.0::DOUBLE, 0.5::DOUBLE * COUNT(*) FILTER (WHERE event_id % 3 = 0)) AS correctness_penalty, LEAST(2.0::DOUBLE, 0.5::DOUBLE * COUNT(*) FILTER (WHERE event_id % 3 = 1)) AS coverage_penalty,
    CASE WHEN MIN(event_id) % 2 = 0 THEN LEAST(1.0::DOUBLE, 0.5::DOUBLE * COUNT(*)) END AS clarity_penalty
  FROM events GROUP BY 1, 2, 3),
judged AS (
  SELECT g.repo_name, g.pr_number, g.generation_mode, g.ord, g.score AS generated_score, COALESCE(o.score, 5.0::DOUBLE) AS original_score,
    CASE WHEN g.score > COALESCE(o.score, 5.0::DOUBLE) THEN 'generated' ELSE 'original' END AS prefers, g.correctness_penalty, g.coverage_penalty, g.clarity_penalty
  FROM cell g LEFT JOIN cell o ON g.repo_name = o.repo_name AND g.pr_number = o.pr_number AND o.generation_mode = 'original' WHERE g.generation_mode <> 'original')"""
COMPLETE_SQL = JUDGED_SQL + """,
complete AS (SELECT * FROM judged QUALIFY COUNT(*) OVER (PARTITION BY repo_name, pr_number) = 4),
rows_ AS (SELECT repo_name, pr_number, generation_mode, ord, generated_score, original_score, prefers, correctness_penalty, coverage_penalty, clarity_penalty FROM complete
  UNION ALL (SELECT repo_name, pr_number, 'original', ord, original_score, original_score, 'original', NULL, NULL, NULL FROM complete QUALIFY ROW_NUMBER() OVER (PARTITION BY repo_name, pr_number ORDER BY ord) = 1))"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    mode = F.create_map(*[F.lit(x) for x in ("view", "raw", "click", "cmg_only", "signup", "file_summaries_only", "purchase", "full")])[F.col("event_type")]
    cell = table(spark, d, "events").groupBy(
        F.col("user_id").cast("string").alias("repo_name"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("pr_number"), F.coalesce(mode, F.lit("original")).alias("generation_mode")
    ).agg(
        F.min("event_id").alias("ord"), F.greatest(F.lit(1.0), 5.0 - 0.5 * F.count("*")).alias("score"),
        F.least(F.lit(2.0), 0.5 * F.count_if(F.col("event_id") % 3 == 0)).alias("correctness_penalty"), F.least(F.lit(2.0), 0.5 * F.count_if(F.col("event_id") % 3 == 1)).alias("coverage_penalty"),
        F.when(F.min("event_id") % 2 == 0, F.least(F.lit(1.0), 0.5 * F.count("*"))).alias("clarity_penalty"),
    )
    # The PR's own original is in its group: a window spares a join with itself.
    own = F.max(F.when(F.col("generation_mode") == "original", F.col("score"))).over(Window.partitionBy("repo_name", "pr_number"))
    both = cell.withColumn("original_score", F.coalesce(own, F.lit(5.0))).filter("generation_mode <> 'original'")
    return both.select("repo_name", "pr_number", "generation_mode", "ord", F.col("score").alias("generated_score"), "original_score", S.preference("score", "original_score").alias("prefers"), "correctness_penalty", "coverage_penalty", "clarity_penalty")


def complete(spark: SparkSession, d: str) -> DataFrame:
    return A.complete_groups(judged(spark, d), ["repo_name", "pr_number"], "generation_mode", REQUIRED)


def with_original(spark: SparkSession, d: str) -> DataFrame:
    """A2: a synthetic row of mode original per PR, from its first row."""
    rows = complete(spark, d)
    lead = first(rows.select("repo_name", "pr_number", "ord", "original_score"), ["repo_name", "pr_number"], ["ord"])
    original = lead.select("repo_name", "pr_number", F.lit("original").alias("generation_mode"), "ord", F.col("original_score").alias("generated_score"), "original_score", F.lit("original").alias("prefers"))
    return rows.unionByName(original, allowMissingColumns=True)


def mode_score_stats(spark: SparkSession, d: str) -> DataFrame:
    """Score statistics by mode over complete PRs."""
    return A.score_stats(with_original(spark, d), ["generation_mode"])


MODE_STATS_SQL = f"""WITH {COMPLETE_SQL}
SELECT generation_mode, COUNT(*) AS n, ROUND(AVG(generated_score), 6) AS avg_generated, ROUND(AVG(original_score), 6) AS avg_original, ROUND(AVG(generated_score - original_score), 6) AS avg_delta,
ROUND(MEDIAN(generated_score), 6) AS median_generated, ROUND(STDDEV_SAMP(generated_score), 6) AS stdev_generated, ROUND(AVG(CASE WHEN prefers = 'generated' THEN 1.0::DOUBLE ELSE 0 END), 6) AS pref_rate,
ROUND(AVG(COALESCE(correctness_penalty, 0.0::DOUBLE)), 6) AS avg_correctness_penalty, ROUND(AVG(COALESCE(coverage_penalty, 0.0::DOUBLE)), 6) AS avg_coverage_penalty, ROUND(AVG(COALESCE(clarity_penalty, 0.0::DOUBLE)), 6) AS avg_clarity_penalty FROM rows_ GROUP BY 1"""


def winner(spark: SparkSession, d: str) -> DataFrame:
    """The mode of the best mean; of equal ones the one seen first."""
    means = with_original(spark, d).groupBy("generation_mode").agg(F.round(F.avg("generated_score"), 9).alias("avg"), F.min("ord").alias("seen"))
    return means.agg(F.max_by("generation_mode", F.struct("avg", -F.col("seen"))).alias("winner"), F.round(F.max("avg"), 6).alias("avg_generated"))


WINNER_SQL = f"""WITH {COMPLETE_SQL}, m AS (SELECT generation_mode, ROUND(AVG(generated_score), 9) AS a, MIN(ord) AS seen FROM rows_ GROUP BY 1)
SELECT generation_mode AS winner, ROUND(a, 6) AS avg_generated FROM m ORDER BY a DESC, seen LIMIT 1"""


def complete_prs(spark: SparkSession, d: str) -> DataFrame:
    """The PRs that have all four modes."""
    return complete(spark, d).select("repo_name", "pr_number").distinct()


COMPLETE_PRS_SQL = f"WITH {COMPLETE_SQL} SELECT DISTINCT repo_name, pr_number FROM complete"


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type."""
    return first(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


FIRST_SQL = "SELECT user_id, event_type, MIN(event_id) AS event_id FROM events GROUP BY 1, 2"


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """D3: the last value of each user, week and type."""
    rows = table(spark, d, "events").select("user_id", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("week"), "event_type", "event_id", "value")
    return latest(rows, ["user_id", "week", "event_type"], ["event_id"]).select("user_id", "week", "event_type", F.round("value", 6).alias("value"))


LAST_SQL = "SELECT user_id, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS INT) AS week, event_type, ROUND(ARG_MAX(value, event_id), 6) AS value FROM events GROUP BY 1, 2, 3"


def raw_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each mode's mean less that of raw, without a join."""
    means = complete(spark, d).groupBy("generation_mode").agg(F.avg("generated_score").alias("a"))
    base = F.max(F.when(F.col("generation_mode") == "raw", F.col("a"))).over(Window.partitionBy(F.lit(0)))
    return means.select("generation_mode", F.round(F.col("a") - base, 6).alias("delta"))


DELTA_SQL = f"""WITH {COMPLETE_SQL}, m AS (SELECT generation_mode, AVG(generated_score) AS a FROM complete GROUP BY 1)
SELECT m.generation_mode, ROUND(m.a - r.a, 6) AS delta FROM m, m r WHERE r.generation_mode = 'raw'"""


#: Penalties made of the events: what is wrong follows from the event's type.
PENALTY_SQL = """pen AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'raw' WHEN 'click' THEN 'cmg_only' WHEN 'signup' THEN 'file_summaries_only' ELSE 'full' END AS generation_mode, user_id, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS INT) AS week,
  CASE WHEN event_id % 7 = 0 THEN 'style only' WHEN event_id % 11 = 0 THEN 'Missing mention of a key file' WHEN event_id % 5 = 0 THEN 'Unsupported claim about caching'
       WHEN event_id % 3 = 0 THEN 'Tests section is absent' WHEN event_id % 2 = 0 THEN 'Linked issue is not listed' ELSE 'Section header malformed' END AS reason FROM events),
cat AS (SELECT *, CASE WHEN LOWER(reason) LIKE '%linked issue%' THEN 'linked_issue_mismatch' WHEN LOWER(reason) LIKE '%tests section%' THEN 'missing_test_coverage' WHEN LOWER(reason) LIKE '%unsupported claim%' THEN 'unsupported_specifics'
  WHEN LOWER(reason) LIKE '%missing mention%' THEN 'missing_key_changes' WHEN LOWER(reason) LIKE '%section header%' THEN 'format_structure' ELSE 'other' END AS category FROM pen)"""
CATEGORIES = ["linked_issue_mismatch", "missing_test_coverage", "unsupported_specifics", "missing_key_changes", "format_structure", "other"]


def penalties(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    mode = F.when(F.col("event_type") == "view", "raw").when(F.col("event_type") == "click", "cmg_only").when(F.col("event_type") == "signup", "file_summaries_only").otherwise("full")
    reason = (
        F.when(e % 7 == 0, "style only").when(e % 11 == 0, "Missing mention of a key file").when(e % 5 == 0, "Unsupported claim about caching")
        .when(e % 3 == 0, "Tests section is absent").when(e % 2 == 0, "Linked issue is not listed").otherwise("Section header malformed")
    )
    return table(spark, d, "events").select("event_id", "user_id", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("week"), mode.alias("generation_mode"), reason.alias("reason")).withColumn("category", T.penalty_category("reason"))


def penalty_counts(spark: SparkSession, d: str) -> DataFrame:
    """By mode the judged cells (a user's week), those with a penalty, and penalties by category; every fourth event carries none."""
    rows = penalties(spark, d).withColumn("category", F.when(F.col("event_id") % 4 != 0, F.col("category")))
    return A.category_counts(rows, "generation_mode", ["user_id", "week"], "category", CATEGORIES)


_COUNTS = ["linked_issue_mismatch", "missing_test_coverage", "unsupported_specifics", "missing_key_changes", "format_structure", "other"]
PENALTY_COUNTS_SQL = f"""WITH {PENALTY_SQL}, c AS (SELECT generation_mode, user_id, week, COUNT(*) FILTER (WHERE event_id % 4 <> 0) AS k, {', '.join(f"COUNT(*) FILTER (WHERE event_id % 4 <> 0 AND category = '{c}') AS {c}" for c in _COUNTS)} FROM cat GROUP BY 1, 2, 3),
s AS (SELECT COALESCE(generation_mode, 'all') AS generation_mode, COUNT(*) AS n, COUNT(*) FILTER (WHERE k > 0) AS penalized, SUM(k)::BIGINT AS total, {', '.join(f"SUM({c})::BIGINT AS {c}" for c in _COUNTS)} FROM c GROUP BY GROUPING SETS ((generation_mode), ()))
SELECT *, ROUND(penalized / n::DOUBLE, 6) AS penalized_rate, {', '.join(f"ROUND({c} / total::DOUBLE, 6) AS {c}_rate" for c in _COUNTS)} FROM s"""


def penalty_delta(spark: SparkSession, d: str) -> DataFrame:
    """By category the counts of raw and full and their difference."""
    m = F.col("generation_mode")
    counts = penalties(spark, d).groupBy("category").agg(F.count_if(m == "raw").alias("raw_count"), F.count_if(m == "full").alias("full_count"))
    return counts.withColumn("delta", F.col("full_count") - F.col("raw_count"))


PENALTY_DELTA_SQL = f"""WITH {PENALTY_SQL} SELECT category, COUNT(*) FILTER (WHERE generation_mode = 'raw') AS raw_count, COUNT(*) FILTER (WHERE generation_mode = 'full') AS full_count, full_count - raw_count AS delta FROM cat GROUP BY 1"""


def judge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Score, preference and first reason from three penalties."""
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 5) * 0.5).alias("a"), ((F.col("event_id") % 3) * 0.75).alias("b"), ((F.col("event_id") % 2) * 0.25).alias("c"), F.coalesce(F.col("value"), F.lit(0.0)).alias("v"))
    score = S.judge_score("a", "b", "c")
    return e.select("event_id", score.alias("score"), S.preference(score, F.lit(3.5)).alias("prefers"), S.primary_reason("a", "b", "c").alias("reason"))


JUDGE_RULES_SQL = """WITH e AS (SELECT event_id, (event_id % 5) * 0.5::DOUBLE AS a, (event_id % 3) * 0.75::DOUBLE AS b, (event_id % 2) * 0.25::DOUBLE AS c FROM events),
s AS (SELECT *, ROUND(GREATEST(1.0::DOUBLE, LEAST(5.0::DOUBLE, 5.0::DOUBLE - (a + b + c))), 1) AS score FROM e)
SELECT event_id, score, CASE WHEN score > 3.5 THEN 'generated' ELSE 'original' END AS prefers,
CASE WHEN GREATEST(a, b, c) <= 0 THEN NULL WHEN a = GREATEST(a, b, c) THEN 'correctness' WHEN b = GREATEST(a, b, c) THEN 'coverage' ELSE 'clarity' END AS reason FROM s"""


def resume(spark: SparkSession, d: str) -> DataFrame:
    """Generations whose repository, PR and mode have no rating that names that mode yet."""
    label = F.regexp_replace(F.lower(F.trim("c1")), "[ -]+", "_")
    done = table(spark, d, "ratings").select("repo_name", "pr_number", label.alias("generation_mode")).filter("generation_mode IS NOT NULL").distinct()
    return table(spark, d, "generations").select("repo_name", "pr_number", "generation_mode").distinct().join(done, ["repo_name", "pr_number", "generation_mode"], "left_anti")


RESUME_SQL = """WITH done AS (SELECT DISTINCT repo_name, pr_number, REGEXP_REPLACE(LOWER(TRIM(c1)), '[ -]+', '_', 'g') AS m FROM ratings)
SELECT DISTINCT g.repo_name, g.pr_number, generation_mode FROM generations g ANTI JOIN done r ON g.repo_name = r.repo_name AND g.pr_number = r.pr_number AND g.generation_mode = r.m"""


def baseline_mode(spark: SparkSession, d: str) -> DataFrame:
    """The mode a PR's evidence is taken from: full, else with summaries, else the first."""
    want = F.when(F.col("generation_mode") == "full", 0).when(F.col("generation_mode") == "file_summaries_only", 1).otherwise(2)
    return table(spark, d, "generations").groupBy("repo_name", "pr_number").agg(F.min_by("generation_mode", F.struct(want, "generation_id")).alias("baseline"))


BASELINE_SQL = """SELECT repo_name, pr_number, ARG_MIN(generation_mode, CASE generation_mode WHEN 'full' THEN 0 WHEN 'file_summaries_only' THEN 1 ELSE 2 END * 100000000000 + generation_id) AS baseline FROM generations GROUP BY 1, 2"""

QUERIES = {
    "A1_mode_score_stats": (mode_score_stats, MODE_STATS_SQL),
    "A4_winner": (winner, WINNER_SQL),
    "P15_A25_complete_prs": (complete_prs, COMPLETE_PRS_SQL),
    "D1_D2_first_wins": (first_wins, FIRST_SQL),
    "D3_last_wins": (last_wins, LAST_SQL),
    "J13_raw_delta": (raw_delta, DELTA_SQL),
    "A7_A8_penalty_counts": (penalty_counts, PENALTY_COUNTS_SQL),
    "A9_penalty_delta": (penalty_delta, PENALTY_DELTA_SQL),
    "M15_M18_judge_rules": (judge_rules, JUDGE_RULES_SQL),
    "P18_resume": (resume, RESUME_SQL),
    "N6_baseline_mode": (baseline_mode, BASELINE_SQL),
}
