"""Queries over the property graph and the contexts of pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import chunking as C
from tracewright.operators import graph as G
from tracewright.operators.dedupe import by_source, condensed, latest, upsert
from tracewright.plans import sqlparts as Q
from tracewright.session import table


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    repos, prs, issues, commits, files = (table(spark, d, t) for t in ("repos", "pull_requests", "issues", "commits", "pr_files"))
    n = G.nodes(repos, prs, issues, commits, files)
    return n, G.known_edges(G.edges(prs, issues, commits, files), n)


NODES_SQL = """nodes AS (SELECT 'repo:' || full_name AS id, 'Repository' AS label FROM repos UNION SELECT 'pr:' || repo || '#' || number, 'PullRequest' FROM pull_requests UNION SELECT 'issue:' || repo || '#' || number, 'Issue' FROM issues
UNION SELECT 'commit:' || sha, 'Commit' FROM commits UNION SELECT 'file:' || repo || ':' || path, 'File' FROM pr_files)"""
EDGES_SQL = NODES_SQL + """, e AS (SELECT 'repo:' || repo AS src, 'pr:' || repo || '#' || number AS dst, 'REPO_HAS_PR' AS label, NULL::VARCHAR AS keyword, NULL::VARCHAR AS status FROM pull_requests
UNION SELECT 'pr:' || repo || '#' || pr_number, 'issue:' || repo || '#' || number, 'PR_LINKS_ISSUE', keyword_used, NULL FROM issues UNION SELECT 'pr:' || repo || '#' || pr_number, 'commit:' || sha, 'PR_CONTAINS_COMMIT', NULL, NULL FROM commits
UNION SELECT 'pr:' || repo || '#' || pr_number, 'file:' || repo || ':' || path, 'PR_MODIFIES_FILE', NULL, status FROM pr_files),
edges AS (SELECT * FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges whose ends are known, each set of attributes once."""
    return _graph(spark, d)[1]


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges by label."""
    n, e = _graph(spark, d)
    each = n.select(F.lit("node").alias("part"), "label").unionByName(e.select(F.lit("edge").alias("part"), "label"))
    return each.groupBy("part", "label").agg(F.count("*").alias("n"))


COUNTS_SQL = f"WITH {EDGES_SQL} SELECT 'node' AS part, label, COUNT(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', label, COUNT(*) FROM edges GROUP BY 2"


def node_link(spark: SparkSession, d: str) -> DataFrame:
    """The graph as JSON texts and read again."""
    n, e = G.from_node_link(G.to_node_link(*_graph(spark, d)))
    return n.select(F.lit("nodes").alias("part"), "id", F.lit(None).cast("string").alias("dst"), "label").unionByName(e.select(F.lit("links").alias("part"), F.col("src").alias("id"), "dst", "label"))


NODE_LINK_SQL = f"WITH {EDGES_SQL} SELECT 'nodes' AS part, id, NULL::VARCHAR AS dst, label FROM nodes UNION ALL SELECT 'links', src, dst, label FROM edges"


def pr_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Of each attribute of a PR the last value that isn't null."""
    rows = table(spark, d, "pull_requests").select("node_id", "ingested_at", "title", "state", "base_branch", "branch_name", "additions")
    return upsert(rows, ["node_id"], "ingested_at")


UPSERT_SQL = "SELECT node_id, " + ", ".join(f"ARG_MAX({c}, ingested_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("title", "state", "base_branch", "branch_name", "additions")) + " FROM pull_requests GROUP BY 1"


def issue_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each issue of a PR once; the pattern search goes before the query interface."""
    rows = table(spark, d, "issues").select("repo", "number", "pr_number", "source", "keyword_used")
    return by_source(rows, ["repo", "number", "pr_number"], F.when(F.col("source") == "regex", 0).otherwise(1), ["source", "keyword_used"])


ISSUE_SQL = "SELECT repo, number, pr_number, source, keyword_used FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY repo, number, pr_number ORDER BY CASE WHEN source = 'regex' THEN 0 ELSE 1 END, source NULLS FIRST, keyword_used NULLS FIRST) AS k FROM issues) WHERE k = 1"


def commit_owner(spark: SparkSession, d: str) -> DataFrame:
    """The PR of each commit."""
    return G.commit_owner(table(spark, d, "commits"))


OWNER_SQL = "SELECT sha, ARG_MAX(repo, (ingested_at, repo, pr_number)) AS repo, ARG_MAX(pr_number, (ingested_at, repo, pr_number)) AS pr_number FROM commits GROUP BY 1"


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Of each PR its ordered commits, files and issues in one row, keys as text."""
    prs = table(spark, d, "pull_requests").select("repo", F.col("number").alias("pr_number")).distinct()
    gather = lambda t, c, o: table(spark, d, t).groupBy("repo", "pr_number").agg(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(o))
    out = prs
    for t, c, o in (("commits", "sha", "commits"), ("pr_files", "file_id", "files"), ("issues", "number", "issues")):
        out = out.join(gather(t, c, o), ["repo", "pr_number"], "left")
    names = table(spark, d, "repos").select(F.col("full_name").alias("repo"), F.col("language").alias("repo_language"))
    return out.join(names, "repo", "left").select("repo", "pr_number", *[F.coalesce(c, F.lit("")).alias(c) for c in ("commits", "files", "issues")], "repo_language")


def _gather_sql(t: str, c: str, o: str) -> str:
    return f"{o}_ AS (SELECT repo, pr_number, STRING_AGG(DISTINCT CAST({c} AS VARCHAR), ',' ORDER BY CAST({c} AS VARCHAR)) AS {o} FROM {t} GROUP BY 1, 2)"


CONTEXTS_SQL = f"""WITH {_gather_sql('commits', 'sha', 'commits')}, {_gather_sql('pr_files', 'file_id', 'files')}, {_gather_sql('issues', 'number', 'issues')}, p AS (SELECT DISTINCT repo, number AS pr_number FROM pull_requests)
SELECT p.repo, p.pr_number, COALESCE(commits, '') AS commits, COALESCE(files, '') AS files, COALESCE(issues, '') AS issues, r.language AS repo_language
FROM p LEFT JOIN commits_ USING (repo, pr_number) LEFT JOIN files_ USING (repo, pr_number) LEFT JOIN issues_ USING (repo, pr_number) LEFT JOIN repos r ON r.full_name = p.repo"""


def lookup(spark: SparkSession, d: str) -> DataFrame:
    """PRs for wanted (repo, number) pairs by exact name, else without regard to case."""
    prs = table(spark, d, "pull_requests").select("repo", "number", "node_id").distinct()
    wanted = table(spark, d, "ratings").select(F.when(F.col("sheet_id") % 3 == 0, F.upper("repo_name")).otherwise(F.col("repo_name")).alias("asked"), "pr_number").distinct()
    exact = wanted.join(prs, (wanted["asked"] == prs["repo"]) & (wanted["pr_number"] == prs["number"]), "left").select("asked", "pr_number", F.col("node_id").alias("exact"))
    low = prs.groupBy(F.lower("repo").alias("low"), "number").agg(F.min("node_id").alias("fallback"))
    both = exact.join(low, (F.lower("asked") == F.col("low")) & (F.col("pr_number") == F.col("number")), "left")
    return both.select("asked", "pr_number", F.coalesce("exact", "fallback").alias("node_id"))


LOOKUP_SQL = """WITH w AS (SELECT DISTINCT CASE WHEN sheet_id % 3 = 0 THEN UPPER(repo_name) ELSE repo_name END AS asked, pr_number FROM ratings), p AS (SELECT LOWER(repo) AS low, number, MIN(node_id) AS node_id FROM pull_requests GROUP BY 1, 2)
SELECT asked, pr_number, p.node_id FROM w LEFT JOIN p ON LOWER(asked) = low AND pr_number = number"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    """Wanted PRs out of raw text lines; blank and non-numeric ones are skipped, first wins."""
    from tracewright.sources.targets import parse_targets

    raw = table(spark, d, "pull_requests").select(F.col("repo").alias("repo_name"), F.when(F.col("is_draft"), F.concat(F.col("number").cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.col("number").cast("string"))).alias("pr_number"))
    return parse_targets(raw).distinct()


TARGETS_SQL = "SELECT DISTINCT repo AS repo_name, number AS pr_number FROM pull_requests WHERE NOT COALESCE(is_draft, FALSE)"


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids taken apart; every underscore parts, two parts make the name."""
    from tracewright.sources.targets import parse_ids

    raw = table(spark, d, "pull_requests").select(F.concat(F.translate("repo", "/", "_"), F.lit("_"), F.col("number").cast("string")).alias("id"))
    return parse_ids(raw).distinct()


IDS_SQL = "WITH i AS (SELECT DISTINCT REPLACE(repo, '/', '_') AS n, number FROM pull_requests) SELECT DISTINCT SPLIT_PART(n, '_', 1) || '/' || SPLIT_PART(n, '_', 2) AS repo_name, number AS pr_number FROM i"


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Issues named behind a closing keyword, in URL, cross-repository or short form; the issue's state where it is known."""
    from tracewright.operators.issues import linked_issues

    rows = linked_issues(table(spark, d, "commits").select("repo", "sha", "message").distinct(), "repo", "message", ["sha"])
    known = table(spark, d, "issues").groupBy("repo", "number").agg(F.min("state").alias("state"))
    return rows.join(known, (rows["issue_repo"] == known["repo"]) & (rows["issue_number"] == known["number"]), "left").select("sha", "keyword_used", "issue_repo", "issue_number", "state")


LINKED_SQL = r"""WITH m AS (SELECT DISTINCT repo, sha, message FROM commits), l AS (SELECT repo, sha, UNNEST(STRING_SPLIT(message, CHR(10))) AS line FROM m WHERE message IS NOT NULL),
k AS (SELECT repo, sha, LOWER(REGEXP_EXTRACT(line, '(?i)\b(close[sd]?|fix(?:es|ed)?|resolve[sd]?)\b(.*)', 1)) AS keyword_used, REGEXP_EXTRACT(line, '(?i)\b(close[sd]?|fix(?:es|ed)?|resolve[sd]?)\b(.*)', 2) AS rest FROM l),
r AS (SELECT repo, sha, keyword_used, UNNEST(REGEXP_EXTRACT_ALL(rest, '(?i)https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/issues/\d+|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+|#\d+')) AS ref FROM k),
f AS (SELECT DISTINCT sha, keyword_used, CASE WHEN REGEXP_MATCHES(ref, '(?i)^http') THEN REGEXP_EXTRACT(ref, '(?i)https?://[^/]+/([\w.-]+/[\w.-]+)/', 1) WHEN REGEXP_MATCHES(ref, '^#') THEN repo ELSE REGEXP_EXTRACT(ref, '^(.*)#', 1) END AS issue_repo, TRY_CAST(REGEXP_EXTRACT(ref, '(\d+)$', 1) AS INT) AS issue_number FROM r),
i AS (SELECT repo, number, MIN(state) AS state FROM issues GROUP BY 1, 2)
SELECT f.sha, f.keyword_used, f.issue_repo, f.issue_number, i.state FROM f LEFT JOIN i ON f.issue_repo = i.repo AND f.issue_number = i.number"""


def _pr_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "pr_files").select("repo", "pr_number", "file_id", "ingested_at", F.size(T.lines("patch")).alias("n")), ["file_id"], ["ingested_at"])
    items = rows.groupBy("repo", "pr_number").agg(F.array_sort(F.collect_list(F.struct("file_id", "n"))).alias("i"))
    return items.select("repo", "pr_number", F.transform("i", lambda x: x["file_id"]).alias("ids"), F.transform("i", lambda x: x["n"]).alias("n"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Files of a PR in chunks of 120 diff lines; with 3 files at most; with 40 lines spent beforehand."""
    c = _pr_costs(spark, d)
    made = c.select("repo", "pr_number", F.arrays_zip("ids", C.greedy_chunks(F.col("n"), 120).alias("a"), C.greedy_chunks(F.col("n"), 120, 3).alias("b"), C.greedy_chunks(F.col("n"), 120, None, 40).alias("c")).alias("z"))
    z = made.select("repo", "pr_number", F.explode("z").alias("z"))
    return z.select("repo", "pr_number", F.col("z.ids").alias("file_id"), F.col("z.a").alias("by_lines"), F.col("z.b").alias("by_both"), F.col("z.c").alias("with_base"))


def _fold_sql(most: str, base: int, name: str) -> str:
    return f"""{name} AS (SELECT repo, pr_number, i, n, 0 AS chunk, {base} + n AS cost, 1 AS k, {base} + n >= 120 AS closed FROM it WHERE i = 1
UNION ALL SELECT it.repo, it.pr_number, it.i, it.n, CASE WHEN f.closed OR f.cost + it.n > 120 {most} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.closed OR f.cost + it.n > 120 {most} THEN {base} + it.n ELSE f.cost + it.n END,
CASE WHEN f.closed OR f.cost + it.n > 120 {most} THEN 1 ELSE f.k + 1 END, (f.closed OR f.cost + it.n > 120 {most}) AND {base} + it.n >= 120 FROM {name} f JOIN it ON it.repo = f.repo AND it.pr_number = f.pr_number AND it.i = f.i + 1)"""


_ITEMS_SQL = f"files AS (SELECT * FROM pr_files QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ingested_at DESC) = 1), it AS (SELECT repo, pr_number, file_id, LEN({Q.lines('patch')})::INT AS n, ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY file_id) AS i FROM files)"
CHUNKS_SQL = f"""WITH RECURSIVE {_ITEMS_SQL}, {_fold_sql('', 0, 'fa')}, {_fold_sql('OR f.k >= 3', 0, 'fb')}, {_fold_sql('', 40, 'fc')}
SELECT it.repo, it.pr_number, it.file_id, fa.chunk AS by_lines, fb.chunk AS by_both, fc.chunk AS with_base FROM it JOIN fa USING (repo, pr_number, i) JOIN fb USING (repo, pr_number, i) JOIN fc USING (repo, pr_number, i)"""


def shrunk_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Its second pass: in a chunk that with its base still is beyond the budget of 120 lines, every diff is cut to an eighth of the budget."""
    c = _pr_costs(spark, d)
    made = c.select("repo", "pr_number", F.explode(F.arrays_zip("ids", "n", C.greedy_chunks(F.col("n"), 120, None, 40, lone=False).alias("chunk"))).alias("z")).select("repo", "pr_number", F.col("z.ids").alias("file_id"), F.col("z.n").alias("n"), F.col("z.chunk").alias("chunk"))
    over = 40 + F.sum("n").over(Window.partitionBy("repo", "pr_number", "chunk")) > 120
    return made.select("repo", "pr_number", "file_id", "chunk", F.when(over, F.least("n", F.lit(120 // 8))).otherwise(F.col("n")).alias("kept"))


SHRUNK_SQL = f"""WITH RECURSIVE {_ITEMS_SQL}, fo AS (SELECT repo, pr_number, i, n, 0 AS chunk, 40 + n AS cost FROM it WHERE i = 1
UNION ALL SELECT it.repo, it.pr_number, it.i, it.n, CASE WHEN f.cost + it.n > 120 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.cost + it.n > 120 THEN 40 + it.n ELSE f.cost + it.n END FROM fo f JOIN it ON it.repo = f.repo AND it.pr_number = f.pr_number AND it.i = f.i + 1)
SELECT it.repo, it.pr_number, it.file_id, chunk, CASE WHEN 40 + SUM(it.n) OVER (PARTITION BY it.repo, it.pr_number, chunk) > 120 THEN LEAST(it.n, 15) ELSE it.n END AS kept FROM it JOIN fo USING (repo, pr_number, i)"""


def budget(spark: SparkSession, d: str) -> DataFrame:
    """How many files of a PR fit a budget of 100 lines; the first always does."""
    return _pr_costs(spark, d).select("repo", "pr_number", C.budget_prefix(F.col("n"), 100).alias("kept"), F.size("n").alias("files"))


BUDGET_SQL = f"WITH {_ITEMS_SQL}, r AS (SELECT *, SUM(n) OVER (PARTITION BY repo, pr_number ORDER BY i) AS run FROM it) SELECT repo, pr_number, COALESCE(MIN(i) FILTER (WHERE i > 1 AND run > 100) - 1, COUNT(*))::INT AS kept, COUNT(*)::INT AS files FROM r GROUP BY 1, 2"


def file_batches(spark: SparkSession, d: str) -> DataFrame:
    """Files of a PR in batches of three."""
    rows = table(spark, d, "pr_files").select("repo", "pr_number", "file_id").distinct()
    return C.batches(rows, ["repo", "pr_number"], ["file_id"], 3)


BATCHES_SQL = "WITH f AS (SELECT DISTINCT repo, pr_number, file_id FROM pr_files) SELECT *, ((ROW_NUMBER() OVER (PARTITION BY repo, pr_number ORDER BY file_id) - 1) // 3)::INT AS batch FROM f"


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of a generation in order, condensed where they say the same."""
    g = table(spark, d, "generations").select("generation_id", F.col("file_summaries").alias("s"), F.transform("file_summaries", lambda x: T.normalize_summary(x["summary"])).alias("texts"))
    kept = g.select("generation_id", "s", F.explode(condensed(F.col("texts"))).alias("pos"))
    return kept.select("generation_id", "pos", F.col("s")[F.col("pos")]["filename"].alias("filename")).distinct()


def summary_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Summaries with the patch of their file, in order; those without one are dropped."""
    g = table(spark, d, "generations").select("generation_id", "repo_name", "pr_number", F.posexplode("file_summaries").alias("pos", "s")).select("generation_id", "repo_name", "pr_number", "pos", F.col("s.filename").alias("path")).distinct()
    f = table(spark, d, "pr_files").select(F.col("repo").alias("repo_name"), "pr_number", "path", F.length("patch").alias("chars")).filter("chars > 0").groupBy("repo_name", "pr_number", "path").agg(F.max("chars").alias("chars"))
    return g.join(f, ["repo_name", "pr_number", "path"]).select("generation_id", "pos", "path", "chars")


SUMMARY_DIFFS_SQL = """WITH g AS (SELECT DISTINCT generation_id, repo_name, pr_number, (i - 1)::INT AS pos, file_summaries[i].filename AS path FROM generations, UNNEST(RANGE(1, LEN(file_summaries) + 1)) AS u(i)),
f AS (SELECT repo, pr_number, path, MAX(LENGTH(patch))::INT AS chars FROM pr_files WHERE LENGTH(patch) > 0 GROUP BY 1, 2, 3)
SELECT generation_id, pos, g.path, chars FROM g JOIN f ON g.repo_name = f.repo AND g.pr_number = f.pr_number AND g.path = f.path"""


def modes_json(spark: SparkSession, d: str) -> DataFrame:
    """Generation records as JSON with nested modes, read again leniently."""
    g = table(spark, d, "generations").groupBy("generation_id").agg(F.first("repo_name").alias("repo_name"), F.first("pr_number").alias("pr_number"), F.first("generation_mode").alias("mode"), F.first("duration_seconds").alias("s"))
    cell = F.struct(F.col("generation_id"), F.col("mode"), F.round("s", 2).alias("s"))
    docs = g.groupBy("repo_name", "pr_number").agg(F.concat(F.lit("noise "), F.to_json(F.struct(F.collect_list(cell).alias("modes")))).alias("raw"))
    parsed = docs.select("repo_name", "pr_number", F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), "modes array<struct<generation_id:long,mode:string,s:double>>").alias("j"))
    return parsed.select("repo_name", "pr_number", F.explode("j.modes").alias("m")).select("repo_name", "pr_number", "m.generation_id", "m.mode", F.col("m.s").alias("seconds"))


MODES_JSON_SQL = "SELECT ANY_VALUE(repo_name) AS repo_name, ANY_VALUE(pr_number) AS pr_number, generation_id, ANY_VALUE(generation_mode) AS mode, ROUND(ANY_VALUE(duration_seconds), 2) AS seconds FROM generations GROUP BY 3"

QUERIES = {
    "D5_J4_edges": (graph_edges, f"WITH {EDGES_SQL} SELECT * FROM edges"),
    "A26_graph_counts": (graph_counts, COUNTS_SQL),
    "S3_K1_node_link": (node_link, NODE_LINK_SQL),
    "D4_upsert": (pr_upsert, UPSERT_SQL),
    "D6_issue_dedupe": (issue_dedupe, ISSUE_SQL),
    "J6_commit_owner": (commit_owner, OWNER_SQL),
    "R12_contexts": (contexts, CONTEXTS_SQL),
    "J5_lookup": (lookup, LOOKUP_SQL),
    "S1_targets": (targets, TARGETS_SQL),
    "S2_T7_ids": (ids, IDS_SQL),
    "T6_W7_linked_issues": (linked, LINKED_SQL),
    "W1_W3_chunks": (chunks, CHUNKS_SQL),
    "W3_shrunk_chunks": (shrunk_chunks, SHRUNK_SQL),
    "P17_budget": (budget, BUDGET_SQL),
    "W4_batches": (file_batches, BATCHES_SQL),
    "D11_M20_condense": (summaries, None),
    "J7_summary_diffs": (summary_diffs, SUMMARY_DIFFS_SQL),
    "N4_N5_modes_json": (modes_json, MODES_JSON_SQL),
}
