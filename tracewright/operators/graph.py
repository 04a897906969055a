"""The property graph of repositories, pull requests, issues, commits and files as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.dedupe import distinct_edges


def nodes(repos: DataFrame, prs: DataFrame, issues: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """(id, label): every node once; a commit is one node however many PRs hold it (Q18)."""
    parts = [
        repos.select(F.concat(F.lit("repo:"), "full_name").alias("id"), F.lit("Repository").alias("label")),
        prs.select(F.concat(F.lit("pr:"), "repo", F.lit("#"), F.col("number").cast("string")).alias("id"), F.lit("PullRequest").alias("label")),
        issues.select(F.concat(F.lit("issue:"), "repo", F.lit("#"), F.col("number").cast("string")).alias("id"), F.lit("Issue").alias("label")),
        commits.select(F.concat(F.lit("commit:"), "sha").alias("id"), F.lit("Commit").alias("label")),
        files.select(F.concat(F.lit("file:"), "repo", F.lit(":"), "path").alias("id"), F.lit("File").alias("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def edges(prs: DataFrame, issues: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, label, keyword, status): parallel edges that differ in their attributes stay."""
    pr = lambda n: F.concat(F.lit("pr:"), "repo", F.lit("#"), F.col(n).cast("string"))
    none = F.lit(None).cast("string")
    parts = [
        prs.select(F.concat(F.lit("repo:"), "repo").alias("src"), pr("number").alias("dst"), F.lit("REPO_HAS_PR").alias("label"), none.alias("keyword"), none.alias("status")),
        issues.select(pr("pr_number").alias("src"), F.concat(F.lit("issue:"), "repo", F.lit("#"), F.col("number").cast("string")).alias("dst"), F.lit("PR_LINKS_ISSUE").alias("label"), F.col("keyword_used").alias("keyword"), none.alias("status")),
        commits.select(pr("pr_number").alias("src"), F.concat(F.lit("commit:"), "sha").alias("dst"), F.lit("PR_CONTAINS_COMMIT").alias("label"), none.alias("keyword"), none.alias("status")),
        files.select(pr("pr_number").alias("src"), F.concat(F.lit("file:"), "repo", F.lit(":"), "path").alias("dst"), F.lit("PR_MODIFIES_FILE").alias("label"), none.alias("keyword"), F.col("status")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def known_edges(all_edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return distinct_edges(all_edges, all_nodes)


def to_node_link(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """One JSON text per node or edge; a graph document is their concatenation, written in parts."""
    n = all_nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct("id", "label")).alias("json"))
    e = all_edges.select(F.lit("links").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label", "keyword", "status")).alias("json"))
    return n.unionByName(e)


def from_node_link(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: nodes and edges out of such texts."""
    n = parts.filter("part = 'nodes'").select(F.from_json("json", "id string, label string").alias("x")).select("x.*")
    e = parts.filter("part = 'links'").select(F.from_json("json", "source string, target string, label string, keyword string, status string").alias("x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.label", "x.keyword", "x.status")
    return n, e


def commit_owner(edge_rows: DataFrame) -> DataFrame:
    """The PR of each commit; one in several PRs goes to the last edge."""
    return edge_rows.groupBy("sha").agg(F.max_by(F.struct("repo", "pr_number"), F.struct("ingested_at", "repo", "pr_number")).alias("o")).select("sha", "o.repo", "o.pr_number")
