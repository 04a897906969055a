"""Queries over rankings and labels of human raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import aggregates as A
from tracewright.operators.ranking import average_rank, position
from tracewright.plans.judged import COMPLETE_SQL, complete, judged, with_original
from tracewright.session import table

MODES = ("view", "click", "signup", "purchase", "error")

#: A respondent ranks the five event types of a week by their total.
SURVEY_SQL = """vcell AS (SELECT user_id AS respondent, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS INT) AS task, event_type AS mode, SUM(CAST(value AS DECIMAL(18, 2))) AS total FROM events GROUP BY 1, 2, 3),
survey AS (SELECT respondent, task, mode, total, CAST(ROW_NUMBER() OVER (PARTITION BY respondent, task ORDER BY total DESC, mode) AS INT) AS rnk, CASE WHEN respondent % 2 = 0 THEN 'aidev' ELSE 'prsummarizer' END AS dataset
  FROM vcell QUALIFY COUNT(*) OVER (PARTITION BY respondent, task) = 5)"""


def survey(spark: SparkSession, d: str) -> DataFrame:
    cell = table(spark, d, "events").groupBy(F.col("user_id").alias("respondent"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("task"), F.col("event_type").alias("mode")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    w = Window.partitionBy("respondent", "task")
    ranked = cell.withColumns({"k": F.count("*").over(w), "rnk": F.row_number().over(w.orderBy(F.desc("total"), "mode"))}).filter("k = 5")
    return ranked.select("respondent", "task", "mode", "total", "rnk", F.when(F.col("respondent") % 2 == 0, "aidev").otherwise("prsummarizer").alias("dataset"))


def _scopes(df: DataFrame) -> DataFrame:
    """Each row for its dataset and for scope 'all'."""
    return df.select("*", F.explode(F.array(F.lit("all"), F.col("dataset"))).alias("scope"))


SCOPE_SQL = "scoped AS (SELECT *, UNNEST(['all', dataset]) AS scope FROM survey)"


def rank_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rank statistics of each mode, over all and by dataset, in the fixed order of modes."""
    return _scopes(survey(spark, d)).groupBy("scope", "mode").agg(
        F.count("*").alias("n"), F.round(F.avg("rnk"), 6).alias("avg_rank"), F.count_if(F.col("rnk") == 1).alias("first_count"), F.round(F.avg((F.col("rnk") == 1).cast("double")), 6).alias("first_rate")
    ).withColumn("mode_order", position(F.col("mode"), MODES))


RANK_SQL = f"""WITH {SURVEY_SQL}, {SCOPE_SQL} SELECT scope, mode, COUNT(*) AS n, ROUND(AVG(rnk), 6) AS avg_rank, COUNT(*) FILTER (WHERE rnk = 1) AS first_count, ROUND(AVG(CASE WHEN rnk = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS first_rate,
(LIST_POSITION(['view', 'click', 'signup', 'purchase', 'error'], mode) - 1)::INT AS mode_order FROM scoped GROUP BY 1, 2"""


def _pairs(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Unordered pairs of the modes of a block: a block's rows are five, taken apart inside the row."""
    cells = F.array_sort(F.collect_list(F.struct(position(F.col("mode"), MODES).alias("o"), "mode", *values)))
    block = df.groupBy(*keys).agg(cells.alias("b"))
    pair = F.flatten(F.transform("b", lambda l: F.transform(F.filter("b", lambda r: r["o"] > l["o"]), lambda r: F.struct(l.alias("l"), r.alias("r")))))
    return block.select(*keys, F.explode(pair).alias("p")).select(*keys, "p.l", "p.r")


def pairwise(spark: SparkSession, d: str) -> DataFrame:
    """How often each mode is ranked before another; equal ranks have no winner."""
    pairs = _pairs(survey(spark, d), ["respondent", "task", "dataset"], "rnk")
    flat = _scopes(pairs.select("dataset", F.col("l.mode").alias("left_mode"), F.col("r.mode").alias("right_mode"), F.col("l.rnk").alias("lr"), F.col("r.rnk").alias("rr")))
    return flat.groupBy("scope", "left_mode", "right_mode").agg(
        F.count("*").alias("comparisons"), F.count_if(F.col("lr") < F.col("rr")).alias("left_wins"), F.count_if(F.col("lr") > F.col("rr")).alias("right_wins"), F.round(F.avg((F.col("lr") < F.col("rr")).cast("double")), 6).alias("left_rate")
    )


_ORD = "LIST_POSITION(['view', 'click', 'signup', 'purchase', 'error'], {0}.mode)"
PAIRWISE_SQL = f"""WITH {SURVEY_SQL}, {SCOPE_SQL}
SELECT l.scope, l.mode AS left_mode, r.mode AS right_mode, COUNT(*) AS comparisons, COUNT(*) FILTER (WHERE l.rnk < r.rnk) AS left_wins, COUNT(*) FILTER (WHERE l.rnk > r.rnk) AS right_wins, ROUND(AVG(CASE WHEN l.rnk < r.rnk THEN 1.0::DOUBLE ELSE 0 END), 6) AS left_rate
FROM scoped l JOIN scoped r ON l.scope = r.scope AND l.respondent = r.respondent AND l.task = r.task AND {_ORD.format('l')} < {_ORD.format('r')} GROUP BY 1, 2, 3"""


def _winners(spark: SparkSession, d: str) -> DataFrame:
    means = survey(spark, d).groupBy("dataset", "task", "mode").agg(F.round(F.avg("rnk"), 9).alias("avg_rank"))
    best = F.rank().over(Window.partitionBy("dataset", "task").orderBy("avg_rank")) == 1
    won = means.withColumn("won", best)
    return won.withColumn("share", F.when(F.col("won"), 1.0 / F.count_if("won").over(Window.partitionBy("dataset", "task"))).otherwise(0.0))


_WINNERS_SQL = """tm AS (SELECT dataset, task, mode, ROUND(AVG(rnk), 9) AS avg_rank FROM survey GROUP BY 1, 2, 3),
won AS (SELECT *, RANK() OVER (PARTITION BY dataset, task ORDER BY avg_rank) = 1 AS won FROM tm),
shared AS (SELECT *, CASE WHEN won THEN 1.0::DOUBLE / COUNT(*) FILTER (WHERE won) OVER (PARTITION BY dataset, task) ELSE 0.0 END AS share FROM won)"""


def task_winners(spark: SparkSession, d: str) -> DataFrame:
    """The best modes of each task; equal ones share the win."""
    return _winners(spark, d).filter("won").select("dataset", "task", "mode", F.round("avg_rank", 6).alias("avg_rank"), F.round("share", 6).alias("share"))


TASK_WINNERS_SQL = f"WITH {SURVEY_SQL}, {_WINNERS_SQL} SELECT dataset, task, mode, ROUND(avg_rank, 6) AS avg_rank, ROUND(share, 6) AS share FROM shared WHERE won"


def winner_totals(spark: SparkSession, d: str) -> DataFrame:
    """Won tasks of every mode, those without any too."""
    modes = spark.createDataFrame([(m,) for m in MODES], "mode string")
    won = _winners(spark, d).groupBy("mode").agg(F.sum("share").alias("wins"))
    return modes.join(won, "mode", "left").select("mode", F.round(F.coalesce("wins", F.lit(0.0)), 6).alias("wins"))


WINNER_TOTALS_SQL = f"WITH {SURVEY_SQL}, {_WINNERS_SQL}, m AS (SELECT UNNEST(['view', 'click', 'signup', 'purchase', 'error']) AS mode) SELECT m.mode, ROUND(COALESCE(SUM(share), 0), 6) AS wins FROM m LEFT JOIN shared USING (mode) GROUP BY 1"


def best_sets(spark: SparkSession, d: str) -> DataFrame:
    """Mean ranks of a task with ties, and the set of best modes in the fixed order."""
    means = survey(spark, d).groupBy("dataset", "task", "mode").agg(F.round(F.avg("rnk"), 1).alias("a"))
    ranked = means.withColumn("pos", average_rank(F.col("a"), ["dataset", "task"])).withColumn("top", F.min("a").over(Window.partitionBy("dataset", "task")))
    best = F.array_sort(F.collect_list(F.when(F.col("a") == F.col("top"), F.struct(position(F.col("mode"), MODES).alias("o"), "mode"))))
    return ranked.groupBy("dataset", "task").agg(F.array_join(F.transform(best, lambda x: x["mode"]), ",").alias("best"), F.round(F.sum(F.col("pos") * F.col("pos")), 6).alias("square_sum"))


BEST_SQL = f"""WITH {SURVEY_SQL}, m AS (SELECT dataset, task, mode, ROUND(AVG(rnk), 1) AS a FROM survey GROUP BY 1, 2, 3),
r AS (SELECT *, RANK() OVER (PARTITION BY dataset, task ORDER BY a) + (COUNT(*) OVER (PARTITION BY dataset, task, a) - 1) / 2.0::DOUBLE AS pos, MIN(a) OVER (PARTITION BY dataset, task) AS top FROM m)
SELECT dataset, task, STRING_AGG(mode, ',' ORDER BY {_ORD.format('r')}) FILTER (WHERE a = top) AS best, ROUND(SUM(pos * pos), 6) AS square_sum FROM r GROUP BY 1, 2"""


def theme_counts(spark: SparkSession, d: str) -> DataFrame:
    """Themes of titles' words by issue state; a text counts for each theme it has."""
    rows = table(spark, d, "issues").select("node_id", "state", F.explode(T.themes(F.concat_ws(" ", "title", "body"))).alias("theme")).distinct()
    return rows.groupBy("state", "theme").agg(F.count("*").alias("n"))


THEME_SQL = "WITH t AS (SELECT DISTINCT node_id, state, LOWER(CONCAT_WS(' ', title, body)) AS x FROM issues), e AS (SELECT node_id, state, UNNEST([k FOR k IN [" + ", ".join(
    f"CASE WHEN REGEXP_MATCHES(x, '{'|'.join(words)}') THEN '{name}' END" for name, words in T.THEMES.items()
) + "] IF k IS NOT NULL]) AS theme FROM t) SELECT state, theme, COUNT(DISTINCT node_id) AS n FROM e GROUP BY 1, 2"


def respondent_quality(spark: SparkSession, d: str) -> DataFrame:
    """Of each author's messages how many there are, are generic, are short."""
    m = F.lower(T.trimmed("message"))
    rows = table(spark, d, "commits").select("author_login", "sha", m.alias("m")).distinct()
    return rows.groupBy("author_login").agg(
        F.count_if(F.col("m") != "").alias("present"), F.count_if(F.col("m").isin(*T.GENERIC_REASONS)).alias("generic"), F.count_if((F.col("m") != "") & (F.length("m") < 20)).alias("short")
    )


QUALITY_SQL = rf"""WITH r AS (SELECT DISTINCT author_login, sha, LOWER(REGEXP_REPLACE(COALESCE(message, ''), '^\s+|\s+$', '', 'g')) AS m FROM commits)
SELECT author_login, COUNT(*) FILTER (WHERE m <> '') AS present, COUNT(*) FILTER (WHERE m IN ({', '.join(f"'{g}'" for g in T.GENERIC_REASONS)})) AS "generic", COUNT(*) FILTER (WHERE m <> '' AND LENGTH(m) < 20) AS short FROM r GROUP BY 1"""


def human_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Mean over tasks of the mean rank, by dataset and over all."""
    task = _scopes(survey(spark, d).groupBy("dataset", "task", "mode").agg(F.avg("rnk").alias("a")))
    return task.groupBy("scope", "mode").agg(F.round(F.avg("a"), 6).alias("avg_rank"), F.count("*").alias("tasks"))


HUMAN_SQL = f"WITH {SURVEY_SQL}, t AS (SELECT dataset, task, mode, AVG(rnk) AS a FROM survey GROUP BY 1, 2, 3), s AS (SELECT *, UNNEST(['all', dataset]) AS scope FROM t) SELECT scope, mode, ROUND(AVG(a), 6) AS avg_rank, COUNT(*) AS tasks FROM s GROUP BY 1, 2"


def judge_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by week; scope 'all' is the mean of the weeks' means."""
    weekly = judged(spark, d).groupBy(F.col("pr_number").cast("string").alias("scope"), "generation_mode").agg(F.avg("generated_score").alias("a"))
    whole = weekly.groupBy(F.lit("all").alias("scope"), "generation_mode").agg(F.avg("a").alias("a"))
    return weekly.unionByName(whole).select("scope", "generation_mode", F.round("a", 6).alias("avg_score"))


JUDGE_SQL = f"WITH {COMPLETE_SQL}, w AS (SELECT CAST(pr_number AS VARCHAR) AS scope, generation_mode, AVG(generated_score) AS a FROM judged GROUP BY 1, 2), u AS (SELECT * FROM w UNION ALL SELECT 'all', generation_mode, AVG(a) FROM w GROUP BY 2) SELECT scope, generation_mode, ROUND(a, 6) AS avg_score FROM u"


def rater_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the two raters of a sheet."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z]+", " ")
    sheets = table(spark, d, "ratings").groupBy("sheet_id").agg(F.max_by(F.struct("c1", "c2"), "ingested_at").alias("s"))
    k = A.kappa(sheets.select(F.trim(clean(F.col("s.c1"))).alias("l"), F.trim(clean(F.col("s.c2"))).alias("r")), "l", "r")
    return k.select("n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round("kappa", 6).alias("kappa"))


_CLEAN = "TRIM(REGEXP_REPLACE(LOWER(TRIM(COALESCE({0}, ''))), '[^a-z]+', ' ', 'g'))"
KAPPA_SQL = f"""WITH s AS (SELECT sheet_id, ARG_MAX({{'c1': c1, 'c2': c2}}, ingested_at) AS s FROM ratings GROUP BY 1), p AS (SELECT {_CLEAN.format('s.c1')} AS l, {_CLEAN.format('s.c2')} AS r FROM s),
n AS (SELECT COUNT(*) AS n, AVG(CASE WHEN l = r THEN 1.0::DOUBLE ELSE 0 END) AS o FROM p), a AS (SELECT l, COUNT(*) AS c FROM p GROUP BY 1), b AS (SELECT r, COUNT(*) AS c FROM p GROUP BY 1),
e AS (SELECT SUM(a.c * b.c / (n.n::DOUBLE * n.n)) AS e FROM a JOIN b ON a.l = b.r, n)
SELECT n, ROUND(o, 6) AS observed, ROUND(e, 6) AS expected, ROUND((o - e) / (1 - e), 6) AS kappa FROM n, e"""


JUDGE_NAMES = ("view", "raw", "click", "cmg_only", "signup", "file_summaries_only", "purchase", "full", "error", "original")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """The ranks of a block with the judge's scores of the same modes; have = how many of the five the judge has."""
    names = F.create_map(*[F.lit(x) for x in JUDGE_NAMES])
    human = survey(spark, d).select("dataset", F.col("respondent").cast("string").alias("repo_name"), F.col("task").alias("pr_number"), "mode", names[F.col("mode")].alias("generation_mode"), "rnk")
    judge = with_original(spark, d).select("repo_name", "pr_number", "generation_mode", F.col("generated_score").alias("score"))
    both = human.join(judge, ["repo_name", "pr_number", "generation_mode"], "left")
    return both.withColumn("have", F.count("score").over(Window.partitionBy("repo_name", "pr_number")))


_ALIGNED_SQL = f"""{COMPLETE_SQL}, {SURVEY_SQL}, al AS (SELECT s.dataset, CAST(respondent AS VARCHAR) AS repo_name, task AS pr_number, mode, rnk, generated_score AS score, COUNT(generated_score) OVER (PARTITION BY respondent, task) AS have
  FROM survey s LEFT JOIN rows_ r ON r.repo_name = CAST(respondent AS VARCHAR) AND r.pr_number = task AND r.generation_mode = CASE mode WHEN 'view' THEN 'raw' WHEN 'click' THEN 'cmg_only' WHEN 'signup' THEN 'file_summaries_only' WHEN 'purchase' THEN 'full' ELSE 'original' END)"""


def missing_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of which the judge lacks a mode."""
    return aligned(spark, d).filter("have < 5").select("dataset", "repo_name", "pr_number").distinct()


MISSING_SQL = f"WITH {_ALIGNED_SQL} SELECT DISTINCT dataset, repo_name, pr_number FROM al WHERE have < 5"


def task_tau(spark: SparkSession, d: str) -> DataFrame:
    """Tau-b of a block's ranks against the judge's scores, both as better or worse."""
    base = aligned(spark, d).filter("have = 5")
    pairs = _pairs(base, ["dataset", "repo_name", "pr_number"], "rnk", "score")
    t = A.tau_b(pairs, ["dataset", "repo_name", "pr_number"], F.col("r.rnk") - F.col("l.rnk"), F.col("l.score") - F.col("r.score"))
    return t.withColumn("tau", F.round("tau", 6))


_TAU_SQL = f"""pr AS (SELECT l.dataset, l.repo_name, l.pr_number, SIGN(r.rnk - l.rnk) AS a, SIGN(l.score - r.score) AS b FROM al l JOIN al r ON l.have = 5 AND l.repo_name = r.repo_name AND l.pr_number = r.pr_number AND {_ORD.format('l')} < {_ORD.format('r')}),
ct AS (SELECT dataset, repo_name, pr_number, COUNT(*) FILTER (WHERE a * b > 0) AS concordant, COUNT(*) FILTER (WHERE a * b < 0) AS discordant, COUNT(*) FILTER (WHERE a = 0 AND b <> 0) AS left_ties, COUNT(*) FILTER (WHERE b = 0 AND a <> 0) AS right_ties, COUNT(*) FILTER (WHERE a = 0 AND b = 0) AS both_ties FROM pr GROUP BY 1, 2, 3),
tau AS (SELECT *, CASE WHEN (concordant + discordant + left_ties) * (concordant + discordant + right_ties) = 0 THEN 0.0::DOUBLE ELSE (concordant - discordant) / SQRT((concordant + discordant + left_ties) * (concordant + discordant + right_ties)::DOUBLE) END AS tau FROM ct)"""
TAU_SQL = f"WITH {_ALIGNED_SQL}, {_TAU_SQL} SELECT * REPLACE (ROUND(tau, 6) AS tau) FROM tau"


def tau_summary(spark: SparkSession, d: str) -> DataFrame:
    """By dataset and over all the blocks, kappa of the winners (a tie goes to the first mode in order), mean and median tau."""
    place = position(F.col("mode"), MODES)
    won = aligned(spark, d).filter("have = 5").groupBy("dataset", "repo_name", "pr_number").agg(F.min_by("mode", F.struct("rnk", place)).alias("h"), F.min_by("mode", F.struct(-F.col("score"), place)).alias("j"))
    k = A.kappa(_scopes(won), "h", "j", ["scope"])
    t = _scopes(task_tau(spark, d)).groupBy("scope").agg(F.count("*").alias("blocks"), F.round(F.avg("tau"), 5).alias("mean_tau"), F.round(F.median("tau"), 5).alias("median_tau"))
    return t.join(k, "scope").select("scope", "blocks", *[F.round(x, 6).alias(x) for x in ("observed", "expected", "kappa")], "mean_tau", "median_tau")


TAU_SUMMARY_SQL = f"""WITH {_ALIGNED_SQL}, {_TAU_SQL}, w AS (SELECT dataset, repo_name, pr_number, ARG_MIN(mode, rnk * 10 + {_ORD.format('al')}) AS h, ARG_MIN(mode, -score * 10 + {_ORD.format('al')} / 10.0) AS j FROM al WHERE have = 5 GROUP BY 1, 2, 3),
ws AS (SELECT *, UNNEST(['all', dataset]) AS scope FROM w), n AS (SELECT scope, COUNT(*) AS n, AVG(CASE WHEN h = j THEN 1.0::DOUBLE ELSE 0 END) AS o FROM ws GROUP BY 1),
hc AS (SELECT scope, h AS m, COUNT(*) AS c FROM ws GROUP BY 1, 2), jc AS (SELECT scope, j AS m, COUNT(*) AS c FROM ws GROUP BY 1, 2),
e AS (SELECT n.scope, COALESCE(SUM(hc.c * jc.c / (n.n::DOUBLE * n.n)), 0.0::DOUBLE) AS e FROM n LEFT JOIN hc ON hc.scope = n.scope LEFT JOIN jc ON jc.scope = hc.scope AND jc.m = hc.m GROUP BY 1),
ts AS (SELECT UNNEST(['all', dataset]) AS scope, ROUND(tau, 6) AS tau FROM tau), tt AS (SELECT scope, COUNT(*) AS blocks, ROUND(AVG(tau), 5) AS mean_tau, ROUND(MEDIAN(tau), 5) AS median_tau FROM ts GROUP BY 1)
SELECT scope, blocks, ROUND(o, 6) AS observed, ROUND(e, 6) AS expected, ROUND(CASE WHEN ABS(e - 1) < 1e-12 THEN 0 ELSE (o - e) / (1 - e) END, 6) AS kappa, mean_tau, median_tau FROM tt JOIN n USING (scope) JOIN e USING (scope)"""


def direction(spark: SparkSession, d: str) -> DataFrame:
    """How often ranks and judged scores agree on whether a mode beats the original; blocks that the judge lacks apart."""
    w = Window.partitionBy("respondent", "task")
    human = survey(spark, d).withColumn("own", F.max(F.when(F.col("mode") == "error", F.col("rnk"))).over(w)).filter("mode <> 'error'")
    names = F.create_map(*[F.lit(x) for x in ("view", "raw", "click", "cmg_only", "signup", "file_summaries_only", "purchase", "full")])
    h = human.select(F.col("respondent").cast("string").alias("repo_name"), F.col("task").alias("pr_number"), names[F.col("mode")].alias("generation_mode"), (F.col("rnk") < F.col("own")).alias("human"))
    j = complete(spark, d).select("repo_name", "pr_number", "generation_mode", (F.col("prefers") == "generated").alias("judge"))
    both = h.join(j, ["repo_name", "pr_number", "generation_mode"], "left")
    return both.groupBy("generation_mode").agg(F.count("judge").alias("n"), F.count_if(F.col("judge").isNull()).alias("missing"), F.round(F.avg((F.col("human") == F.col("judge")).cast("double")), 6).alias("agreement"))


DIRECTION_SQL = f"""WITH {COMPLETE_SQL}, {SURVEY_SQL}, h AS (SELECT CAST(respondent AS VARCHAR) AS repo_name, task AS pr_number, CASE mode WHEN 'view' THEN 'raw' WHEN 'click' THEN 'cmg_only' WHEN 'signup' THEN 'file_summaries_only' WHEN 'purchase' THEN 'full' END AS generation_mode,
rnk < MAX(CASE WHEN mode = 'error' THEN rnk END) OVER (PARTITION BY respondent, task) AS human FROM survey)
SELECT h.generation_mode, COUNT(c.ord) AS n, COUNT(*) FILTER (WHERE c.ord IS NULL) AS missing, ROUND(AVG(CASE WHEN c.ord IS NULL THEN NULL WHEN human = (c.prefers = 'generated') THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement
FROM h LEFT JOIN complete c ON h.repo_name = c.repo_name AND h.pr_number = c.pr_number AND h.generation_mode = c.generation_mode WHERE h.generation_mode IS NOT NULL GROUP BY 1"""


def mode_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Differences of mean ranks for the fixed list of comparisons: original with four, raw with three."""
    pairs = [("error", m) for m in MODES[:4]] + [("view", m) for m in MODES[1:4]]
    listed = spark.createDataFrame(pairs, "base string, mode string")  # seven rows
    means = survey(spark, d).groupBy("mode").agg(F.avg("rnk").alias("a"))
    base = means.select(F.col("mode").alias("base"), F.col("a").alias("b"))
    return means.join(listed, "mode").join(base, "base").select("base", "mode", F.round(F.col("a") - F.col("b"), 6).alias("difference"))


MODE_PAIRS_SQL = f"WITH {SURVEY_SQL}, m AS (SELECT mode, AVG(rnk) AS a FROM survey GROUP BY 1) SELECT b.mode AS base, m.mode, ROUND(m.a - b.a, 6) AS difference FROM m b JOIN m ON (b.mode = 'error' AND m.mode <> 'error') OR (b.mode = 'view' AND m.mode IN ('click', 'signup', 'purchase'))"

QUERIES = {
    "A10_rank_stats": (rank_stats, RANK_SQL),
    "A11_J14_pairwise": (pairwise, PAIRWISE_SQL),
    "A12_task_winners": (task_winners, TASK_WINNERS_SQL),
    "A13_winner_totals": (winner_totals, WINNER_TOTALS_SQL),
    "R8_R9_best_sets": (best_sets, BEST_SQL),
    "A14_T24_themes": (theme_counts, THEME_SQL),
    "A15_respondent_quality": (respondent_quality, QUALITY_SQL),
    "A16_human_ranks": (human_ranks, HUMAN_SQL),
    "A17_J18_judge_means": (judge_means, JUDGE_SQL),
    "A18_kappa": (rater_kappa, KAPPA_SQL),
    "A19_tau_b": (task_tau, TAU_SQL),
    "A20_tau_summary": (tau_summary, TAU_SUMMARY_SQL),
    "J12_missing_blocks": (missing_blocks, MISSING_SQL),
    "A21_direction": (direction, DIRECTION_SQL),
    "J15_mode_pairs": (mode_pairs, MODE_PAIRS_SQL),
}
