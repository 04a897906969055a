"""Queries over pairs and collections of texts: overlap metrics, retrieval, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scores as S
from tracewright.functions import text as T
from tracewright.operators import lexical as L
from tracewright.operators import retrieval as R
from tracewright.plans import sqlparts as Q
from tracewright.session import ensure_checkpoint_dir, spread, table

#: A generated description and the body of its PR; the first version of each counts.
PAIRS_SQL = """g AS (SELECT generation_id, FIRST(generation_mode) AS generation_mode, FIRST(repo_name) AS repo_name, FIRST(pr_number) AS pr_number, MIN(description) AS c FROM generations GROUP BY 1),
b AS (SELECT repo, number, MIN(body) AS r FROM pull_requests GROUP BY 1, 2),
p0 AS (SELECT generation_id, generation_mode, REGEXP_EXTRACT_ALL(LOWER(COALESCE(b.r, '')), '[a-z0-9_]+') AS r, REGEXP_EXTRACT_ALL(LOWER(COALESCE(g.c, '')), '[a-z0-9_]+') AS c FROM g JOIN b ON g.repo_name = b.repo AND g.pr_number = b.number),
p AS (SELECT * FROM p0 WHERE LEN(r) > 0 AND LEN(c) > 0)"""


def _gram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    side = lambda s: f"SELECT generation_id, gr, COUNT(*) AS k FROM (SELECT generation_id, UNNEST([{gram.replace('t[', s + '[')} FOR i IN RANGE(1, LEN({s}) - {n} + 2)]) AS gr FROM p) GROUP BY 1, 2"
    return f"o{n} AS (SELECT x.generation_id, SUM(LEAST(x.k, y.k)) AS m FROM ({side('r')}) x JOIN ({side('c')}) y ON x.generation_id = y.generation_id AND x.gr = y.gr GROUP BY 1)"


GRAMS_SQL = ",\n".join(_gram_sql(n) for n in range(1, 5)) + """,
mt AS (SELECT p.generation_id, generation_mode, LEN(r) AS rl, LEN(c) AS hl, COALESCE(o1.m, 0) AS m1, COALESCE(o2.m, 0) AS m2, COALESCE(o3.m, 0) AS m3, COALESCE(o4.m, 0) AS m4
  FROM p LEFT JOIN o1 USING (generation_id) LEFT JOIN o2 USING (generation_id) LEFT JOIN o3 USING (generation_id) LEFT JOIN o4 USING (generation_id))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generations").groupBy("generation_id").agg(F.first("generation_mode").alias("generation_mode"), F.first("repo_name").alias("repo_name"), F.first("pr_number").alias("pr_number"), F.min("description").alias("candidate"))
    b = table(spark, d, "pull_requests").groupBy(F.col("repo").alias("repo_name"), F.col("number").alias("pr_number")).agg(F.min("body").alias("reference"))
    return g.join(b, ["repo_name", "pr_number"])


def rouge(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of each description against the body of its PR."""
    m = L.pair_metrics(pairs(spark, d), "reference", "candidate")
    return m.select("generation_id", F.round("r1", 6).alias("rouge1"), F.round("r2", 6).alias("rouge2"))


ROUGE_SQL = f"""WITH {PAIRS_SQL}, {GRAMS_SQL} SELECT generation_id, ROUND(2.0::DOUBLE * m1 / (rl + hl), 6) AS rouge1, ROUND(CASE WHEN m2 > 0 THEN 2.0::DOUBLE * m2 / (rl + hl - 2) ELSE 0 END, 6) AS rouge2 FROM mt"""


def mode_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Corpus BLEU-4 of each mode."""
    return L.mode_metrics(L.pair_metrics(pairs(spark, d), "reference", "candidate"), ["generation_mode"]).select("generation_mode", "n", "bleu", "rouge1", "rouge2")


BLEU_SQL = f"""WITH {PAIRS_SQL}, {GRAMS_SQL}, s AS (SELECT generation_mode, COUNT(*) AS n, SUM(m1) AS m1, SUM(m2) AS m2, SUM(m3) AS m3, SUM(m4) AS m4, SUM(hl) AS h, SUM(rl) AS r,
SUM(GREATEST(hl - 1, 0)) AS h2, SUM(GREATEST(hl - 2, 0)) AS h3, SUM(GREATEST(hl - 3, 0)) AS h4, AVG(2.0::DOUBLE * m1 / (rl + hl)) AS r1, AVG(CASE WHEN m2 > 0 THEN 2.0::DOUBLE * m2 / (rl + hl - 2) ELSE 0 END) AS r2 FROM mt GROUP BY 1)
SELECT generation_mode, n, ROUND(CASE WHEN h > r THEN 1 ELSE EXP(1 - r / h::DOUBLE) END * EXP(0.25 * (LN((m1 + 1) / (h + 1)::DOUBLE) + LN((m2 + 1) / (h2 + 1)::DOUBLE) + LN((m3 + 1) / (h3 + 1)::DOUBLE) + LN((m4 + 1) / (h4 + 1)::DOUBLE))), 6) AS bleu, ROUND(r1, 6) AS rouge1, ROUND(r2, 6) AS rouge2 FROM s"""


def mode_lexical(spark: SparkSession, d: str) -> DataFrame:
    """All lexical metrics by mode, the longest common subsequence among them."""
    return L.mode_metrics(L.pair_metrics(pairs(spark, d), "reference", "candidate"), ["generation_mode"])


def _demos(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.code_tokens("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.concat(F.lit("#"), F.col("doc_id").cast("string"))).alias("scope"), tokens.alias("tokens")).select("*", F.size("tokens").alias("size"), (F.col("id") % 7).cast("int").alias("files"))


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and weight of each token of the corpus."""
    stats, _ = R.corpus_stats(_demos(spark, d), "id", "tokens")
    return stats.select("token", "df", F.round("idf", 6).alias("idf"))


_TOKENS = r"[t FOR t IN REGEXP_SPLIT_TO_ARRAY(LOWER(COALESCE(text, '')), '[^\p{L}\p{N}_./#:+-]+') IF t <> '']"
_DEMOS_SQL = f"d AS (SELECT doc_id AS id, COALESCE(source, '#' || CAST(doc_id AS VARCHAR)) AS scope, {_TOKENS} AS tokens, (doc_id % 7)::INT AS files FROM documents), n AS (SELECT COUNT(*) AS n, GREATEST(1.0::DOUBLE, AVG(LEN(tokens))) AS avgdl FROM d), df AS (SELECT token, COUNT(DISTINCT id) AS df FROM (SELECT id, UNNEST(tokens) AS token FROM d) GROUP BY 1)"
BM25_SQL = f"WITH {_DEMOS_SQL} SELECT token, df, ROUND(LN(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, n"


def demos(spark: SparkSession, d: str) -> DataFrame:
    """The three best documents for each document whose id is divisible by 50."""
    ensure_checkpoint_dir(spark)
    docs = spread(_demos(spark, d), "id").checkpoint()
    return R.top_demos(docs, docs.filter("id % 50 = 0"), 3).select("query", "id", F.round("score", 4).alias("score"), "place")


DEMOS_SQL = f"""WITH {_DEMOS_SQL}, tf AS (SELECT id, token, COUNT(*) AS tf FROM (SELECT id, UNNEST(tokens) AS token FROM d) GROUP BY 1, 2),
ds AS (SELECT id, scope, files, LEN(tokens) AS size, LEN(LIST_DISTINCT(tokens)) AS uniq FROM d), qs AS (SELECT * FROM ds WHERE id % 50 = 0),
hit AS (SELECT q.id AS qid, t.id, COUNT(*) AS inter, SUM(q.tf * LN(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ds.size / avgdl))) AS bm
  FROM tf q JOIN tf t ON q.token = t.token JOIN df ON df.token = q.token JOIN ds ON ds.id = t.id, n WHERE q.id % 50 = 0 GROUP BY 1, 2),
c AS (SELECT q.id AS qid, ds.id, COALESCE(hit.bm, 0) AS bm, CASE WHEN q.uniq > 0 AND ds.uniq > 0 THEN COALESCE(inter, 0) / (q.uniq + ds.uniq - COALESCE(inter, 0))::DOUBLE ELSE 0 END
   + 0.2::DOUBLE * (1 - LEAST(ABS(q.uniq - ds.size) / GREATEST(q.uniq, ds.size, 1)::DOUBLE, 1)) + 0.1::DOUBLE * (1 - LEAST(ABS(q.files - ds.files) / GREATEST(q.files, ds.files, 1)::DOUBLE, 1)) AS base
  FROM qs q JOIN ds ON q.scope <> ds.scope LEFT JOIN hit ON hit.qid = q.id AND hit.id = ds.id),
s AS (SELECT *, MIN(bm) OVER (PARTITION BY qid) AS lo, MAX(bm) OVER (PARTITION BY qid) AS hi FROM c)
SELECT qid AS query, id, ROUND(ROUND(0.5 * base + 0.25 * CASE WHEN hi > lo THEN (bm - lo) / (hi - lo) ELSE 0 END, 9), 4) AS score, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(0.5 * base + 0.25 * CASE WHEN hi > lo THEN (bm - lo) / (hi - lo) ELSE 0 END, 9) DESC, id DESC)::INT AS place FROM s QUALIFY place <= 3"""


def commit_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Commits with a good message and a diff that isn't empty, with the PR that holds them last."""
    last = F.max_by(F.struct("repo", "pr_number", "message", "patches", "files_touched"), F.struct("ingested_at", "repo", "pr_number")).alias("c")
    rows = table(spark, d, "commits").groupBy("sha").agg(last).select("sha", "c.*").filter(T.is_good_message("message"))
    diff = rows.withColumn("diff", T.render_diff("patches")).filter("diff <> ''")
    tokens = T.code_tokens("diff")
    pr = F.concat_ws("#", "repo", F.col("pr_number").cast("string"))
    return diff.select(F.col("sha").alias("id"), pr.alias("scope"), F.col("repo").alias("within"), tokens.alias("tokens"), F.coalesce(F.size("files_touched"), F.lit(0)).alias("files"), T.trimmed("message").alias("message")).withColumn("size", F.size("tokens"))


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with its sizes."""
    return commit_corpus(spark, d).select(F.col("id").alias("sha"), F.col("scope").alias("pr"), "message", F.col("size").alias("tokens"), "files")


def _asked(docs: DataFrame) -> DataFrame:
    """The stated queries: commits whose sha, read as a number, is divisible by 50."""
    return docs.filter(F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("long"), F.lit(50)) == 0)


def commit_demos(spark: SparkSession, d: str) -> DataFrame:
    """The three best commits of other PRs for each queried commit."""
    ensure_checkpoint_dir(spark)
    docs = spread(commit_corpus(spark, d).drop("message"), "id").checkpoint()
    return R.top_demos(docs, _asked(docs), 3).select("query", "id", F.round("score", 4).alias("score"), "place")


def repo_demos(spark: SparkSession, d: str) -> DataFrame:
    """The same inside the commit's own repository."""
    ensure_checkpoint_dir(spark)
    docs = spread(commit_corpus(spark, d).drop("message"), "id").checkpoint()
    return R.top_demos(docs, _asked(docs), 3, same=True).select("query", "id", F.round("score", 4).alias("score"), "place")


_RENDERED = f"""ARRAY_TO_STRING(FLATTEN([(CASE WHEN COALESCE(p.filename, '') <> '' THEN ['<FILE> ' || p.filename] ELSE CAST([] AS VARCHAR[]) END) ||
  [CASE SUBSTR(y, 1, 1) WHEN ' ' THEN '<CTX> ' WHEN '+' THEN '<ADD> ' ELSE '<DEL> ' END || SUBSTR(y, 2) FOR y IN {Q.lines('p.patch')} IF SUBSTR(y, 1, 1) IN (' ', '+', '-') AND NOT STARTS_WITH(y, '+++') AND NOT STARTS_WITH(y, '---')] FOR p IN COALESCE(patches, [])]), CHR(10))"""
_CORPUS_SQL = rf"""c0 AS (SELECT sha, ARG_MAX({{'repo': repo, 'pr_number': pr_number, 'message': message, 'patches': patches, 'files_touched': files_touched}}, (ingested_at, repo, pr_number)) AS c FROM commits GROUP BY 1),
c1 AS (SELECT sha, c.repo AS repo, c.pr_number AS pr_number, {Q.trimmed('c.message')} AS message, c.patches AS patches, COALESCE(LEN(c.files_touched), 0)::INT AS files FROM c0),
c2 AS (SELECT *, SUBSTR({_RENDERED}, 1, 40000) AS diff FROM c1 WHERE {Q.good('message')}),
corpus AS (SELECT sha AS id, repo || '#' || pr_number AS scope, repo AS within, {Q.code_tokens('diff')} AS tokens, files, message FROM c2 WHERE diff <> '')"""
CORPUS_SQL = f"WITH {_CORPUS_SQL} SELECT id AS sha, scope AS pr, message, LEN(tokens)::INT AS tokens, files FROM corpus"
_RANKED_SQL = """n AS (SELECT COUNT(*) AS n, GREATEST(1.0::DOUBLE, AVG(LEN(tokens))) AS avgdl FROM d), df AS (SELECT token, COUNT(DISTINCT id) AS df FROM (SELECT id, UNNEST(tokens) AS token FROM d) GROUP BY 1),
tf AS (SELECT id, token, COUNT(*) AS tf FROM (SELECT id, UNNEST(tokens) AS token FROM d) GROUP BY 1, 2),
ds AS (SELECT id, scope, within, files, LEN(tokens) AS size, LEN(LIST_DISTINCT(tokens)) AS uniq FROM d), qs AS (SELECT * FROM ds WHERE CAST('0x' || SUBSTR(id, 1, 8) AS BIGINT) % 50 = 0),
hit AS (SELECT q.id AS qid, t.id, COUNT(*) AS inter, SUM(q.tf * LN(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * ds.size / avgdl))) AS bm
  FROM tf q JOIN qs ON qs.id = q.id JOIN tf t ON q.token = t.token JOIN df ON df.token = q.token JOIN ds ON ds.id = t.id, n GROUP BY 1, 2),
c AS (SELECT q.id AS qid, ds.id, COALESCE(hit.bm, 0) AS bm, CASE WHEN q.uniq > 0 AND ds.uniq > 0 THEN COALESCE(inter, 0) / (q.uniq + ds.uniq - COALESCE(inter, 0))::DOUBLE ELSE 0 END
   + 0.2::DOUBLE * (1 - LEAST(ABS(q.uniq - ds.size) / GREATEST(q.uniq, ds.size, 1)::DOUBLE, 1)) + 0.1::DOUBLE * (1 - LEAST(ABS(q.files - ds.files) / GREATEST(q.files, ds.files, 1)::DOUBLE, 1)) AS base
  FROM qs q JOIN ds ON q.scope <> ds.scope{same} LEFT JOIN hit ON hit.qid = q.id AND hit.id = ds.id),
s AS (SELECT *, MIN(bm) OVER (PARTITION BY qid) AS lo, MAX(bm) OVER (PARTITION BY qid) AS hi FROM c)
SELECT qid AS query, id, ROUND(ROUND(0.5 * base + 0.25 * CASE WHEN hi > lo THEN (bm - lo) / (hi - lo) ELSE 0 END, 9), 4) AS score, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(0.5 * base + 0.25 * CASE WHEN hi > lo THEN (bm - lo) / (hi - lo) ELSE 0 END, 9) DESC, id DESC)::INT AS place FROM s QUALIFY place <= 3"""
COMMIT_DEMOS_SQL = f"WITH {_CORPUS_SQL}, d AS (SELECT * FROM corpus), " + _RANKED_SQL.replace("{same}", "")
REPO_DEMOS_SQL = f"WITH {_CORPUS_SQL}, d AS (SELECT * FROM corpus), " + _RANKED_SQL.replace("{same}", " AND q.within = ds.within")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """M3: cosine of neighbouring vectors, brought to 0..1; the neighbour comes by a shift of the key."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(S.semantic("embedding", "next"), 5).alias("semantic"))


VECTORS_SQL = """SELECT a.vec_id, ROUND((LIST_COSINE_SIMILARITY(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2, 5) AS semantic FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def text_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of the words of a title and its body."""
    rows = table(spark, d, "issues").select("node_id", S.jaccard(F.array_distinct(T.word_tokens("title")), F.array_distinct(T.word_tokens("body"))).alias("j"))
    return rows.select("node_id", F.round("j", 6).alias("jaccard")).distinct()


JACCARD_SQL = """WITH w AS (SELECT node_id, LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(COALESCE(title, '')), '[a-z0-9_]+')) AS a, LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(COALESCE(body, '')), '[a-z0-9_]+')) AS b FROM issues)
SELECT DISTINCT node_id, ROUND(CASE WHEN LEN(a) > 0 AND LEN(b) > 0 THEN LEN(LIST_INTERSECT(a, b)) / LEN(LIST_DISTINCT(a || b))::DOUBLE ELSE 0 END, 6) AS jaccard FROM w"""

QUERIES = {
    "M13_rouge": (rouge, ROUGE_SQL),
    "A6_bleu": (mode_bleu, BLEU_SQL),
    "A5_M14_lexical": (mode_lexical, None),
    "A22_bm25_stats": (bm25_stats, BM25_SQL),
    "M4_M5_demos": (demos, DEMOS_SQL),
    "S4_corpus": (corpus_rows, CORPUS_SQL),
    "J16_J17_commit_demos": (commit_demos, COMMIT_DEMOS_SQL),
    "J17_repo_demos": (repo_demos, REPO_DEMOS_SQL),
    "M3_vectors": (vectors, VECTORS_SQL),
    "M1_D10_jaccard": (text_jaccard, JACCARD_SQL),
}
