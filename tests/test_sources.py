"""Sources, sinks, settings and the incremental store."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import providers
from tracewright.sources import config, files, hub, sinks, survey, targets
from tracewright.streaming import ingest


def test_targets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("repo,pr\na/b, 12\n,3\nc/d,12x\na/b,7\n")
    assert [tuple(r) for r in targets.read_targets(spark, str(tmp_path / "t.csv")).collect()] == [("a/b", 12), ("a/b", 7)]
    (tmp_path / "i.csv").write_text("id\na_b_c_7\nnope\nx_y_z\no_r_3\no_r_3\n")
    assert {tuple(r) for r in targets.read_ids(spark, str(tmp_path / "i.csv")).collect()} == {("a/b", 7), ("o/r", 3)}


def test_records_and_newest(spark, tmp_path):
    (tmp_path / "results_aidev_1.json").write_text(json.dumps([{"a": 1}, "x", {"a": 2}]))
    rows = files.read_records(spark, str(tmp_path), "a int").orderBy("pos").collect()
    assert [(r["pos"], r["dataset"], r["a"]) for r in rows] == [(0, "aidev", 1), (2, "aidev", 2)]
    listing = spark.createDataFrame([("d-1.json", 1), ("d-2.json", 3), ("x.json", 9)], "path string, modificationTime int")
    assert files.newest_file(listing, r"d-\d").first()[0] == "d-2.json"


def test_summary(spark, tmp_path):
    (tmp_path / "s.csv").write_text("mode,score\nraw,4.5\nfull,none\n")
    assert [r["score"] for r in files.read_summary(spark, str(tmp_path / "s.csv"), ["score"]).collect()] == [4.5, None]


def test_graph_document(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "X", "t": "1"}], "links": [{"source": "a", "target": "b", "label": "L", "key": "0"}]}))
    nodes, links = files.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first()["attrs"] == {"t": "1"} and links.first()["dst"] == "b"


KEY = "# key\n## P01 (parsed) — own/rep PR #32\n- Version A: original\n- Version B: generated_raw\n- Version C: generated_cmg_only\n- Version D: generated_file_summaries_only\n- Version E: generated_full\n"


def test_key_and_responses(spark, tmp_path):
    (tmp_path / "key.md").write_text(KEY)
    key = survey.read_key(spark, str(tmp_path / "key.md"))
    row = key.first()
    assert (row["task_id"], row["dataset"], row["repo_name"], row["pr_number"]) == ("P01", "prsummarizer", "own/rep", 32)
    head = ["Timestamp", "r A", "r B", "r C", "r D", "r E", "Q2 (Best): x", "Q3 (Why): x"]
    (tmp_path / "s.csv").write_text(",".join(head) + "\n" + "t,5 (worst),1 (best),2,3,,B,clear\n")
    got = survey.read_responses(spark, str(tmp_path / "s.csv"), key).collect()
    assert {(r["mode"], r["rank"]) for r in got} == {("original", 5), ("generated_raw", 1), ("generated_cmg_only", 2), ("generated_file_summaries_only", 3)}
    assert {r["best"] for r in got} == {"generated_raw"}
    (tmp_path / "bad.md").write_text(KEY.replace("- Version C: generated_cmg_only\n", ""))
    with pytest.raises(Exception, match="missing version"):
        survey.read_key(spark, str(tmp_path / "bad.md")).select("versions").collect()


def test_config(tmp_path):
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    modes = config.normalize_modes([{"name": "Raw"}, {"name": "raw"}, {"name": " "}])
    assert [m["slug"] for m in modes] == ["raw"]
    assert len(config.normalize_modes([])) == 4
    assert [m["name"] for m in config.active_modes(config.normalize_modes([]), ["full"])] == ["full"]
    assert [m["name"] for m in config.active_modes(config.normalize_modes([{"name": "My Mode"}]), [" my-MODE ", ""])] == ["My Mode"]
    assert [m["name"] for m in config.active_modes(config.normalize_modes([]), [" FULL "])] == ["full"]
    assert config.deep_merge({"a": {"x": 1}}, {"a": 2}, {"a": {"y": 3}}) == {"a": {"y": 3}}
    assert len(config.active_modes(config.normalize_modes([]), ["none"])) == 4


def test_hub_source(spark):
    spark.dataSource.register(hub.HubSource)
    df = spark.read.format("hub").option("targets", "a/b#3, c/d#4").option("pageSize", "2").load()
    assert df.groupBy("repo").count().collect()[0]["count"] == 6


def test_retry():
    calls = []

    def failing():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 rate limit")
        return "ok"

    waits = []
    assert hub.retry(failing, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        hub.retry(lambda: (_ for _ in ()).throw(ValueError("other")), sleep=waits.append)


def test_providers(spark):
    df = spark.createDataFrame([("x y",), (None,), ("x y",)], "p string")
    got = [r["answer"] for r in providers.call(df, "s", "p").collect()]
    assert got[0] == got[2] and json.loads(got[0])["message"] == "x y"
    with pytest.raises(ValueError):
        providers.provider_of("nobody")
    assert providers.call_log(providers.call(df, "s", "p"), "p", "answer").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.append_keyed(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    num = spark.createDataFrame([("m", 0.12345, None)], "a string, b double, c double")
    assert tuple(sinks.report_rows(num, ["a", "b", "c"]).first()) == ("m", "0.123", "")
    assert num.select(sinks.percent("b")).first()[0] == "12.3%"
    assert sinks.markdown_rows(df, ["k", "v"]).first()[0] == "| 1 | a |"
    assert sinks.rejected(df, F.when(F.col("k") == 1, "one")).count() == 1


def test_incremental_store(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in (1, 2):
        spark.createDataFrame([(i, "x") for i in range(k * 2)], "k int, v string").write.mode("append").parquet(src)
        ingest.store_new(spark, src, "k int, v string", out, ck, ["k"]).awaitTermination()
        assert spark.read.parquet(out).count() == k * 2
