import json
import subprocess
import sys

import pytest

from millrace import cli, config
from millrace.plans.codegen import pipeline_source, spec_of_table
from millrace.plans.pipeline import Pipeline
from millrace.plans.spec import PipelineSpec
from millrace.runners import BatchRunner, run
from millrace.runners.incremental import beyond, merge_changes
from millrace.streaming import ops
from millrace.streaming.run import start, stop_all, triggered, watch
from millrace.tables.store import TableStore
from millrace.types import Column, Table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def jobs(spark, action):
    """How many Spark jobs an action takes."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{id(action)}"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        action()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "src")
    spark.createDataFrame([(i, f"u{i % 4}", float(i)) for i in range(20)], "id long, who string, v double").coalesce(1).write.parquet(path)
    return {"type": "file", "path": path}


def test_batch(spark, tmp_path, source):
    spec = {"pipeline_id": "p", "source": source, "target": {"type": "table", "path": str(tmp_path / "out"), "mode": "overwrite"}, "transforms": [{"type": "filter", "condition": "id < 10"}, {"type": "mask", "rules": {"who": {"strategy": "redact"}}}], "validation": {"required": ["v"], "keys": ["id"]}, "provenance": True, "state_path": str(tmp_path / "state"), "optimize_every": 2, "vacuum_hours": 0}
    seen = []
    runner = BatchRunner(spark).on_completion(seen.append).on_completion(lambda m: 1 / 0)
    out = runner.run(spec)
    assert out["rows"] == 10 and out["checks"] == {"rows": 10, "nulls_v": 0, "duplicates": 0} and seen[0]["status"] == "success"
    runner.run(spec)
    store = TableStore(spark, str(tmp_path / "out"))
    assert store.manifest()["operation"] == "optimize" and set(store.read().columns) == {"id", "who", "v", "_processed_at", "_pipeline_id"}
    assert json.loads((tmp_path / "state" / "p.json").read_text())["runs"] == 2
    with pytest.raises(ValueError, match="checks failed"):
        run(spark, spec | {"validation": {"required": [], "keys": ["who"], "fail": True}})
    assert spark.range(1).count() == 1  # the session is still there


def test_null_counts_that_stop_nothing_come_from_the_write(spark, tmp_path, source):
    spec = {"pipeline_id": "n", "source": source, "target": {"type": "file", "path": str(tmp_path / "n"), "mode": "overwrite"}, "transforms": [{"type": "filter", "condition": "id < 10"}]}
    checked = spec | {"validation": {"required": ["v", "who"]}}
    run(spark, spec)
    out = []
    assert jobs(spark, lambda: out.append(run(spark, checked))) == jobs(spark, lambda: run(spark, spec))
    assert out[0]["checks"] == {"rows": 10, "nulls_v": 0, "nulls_who": 0} and out[0]["validation_errors"] == 0
    none = run(spark, checked | {"transforms": [{"type": "filter", "condition": "id < 0"}]})
    assert none["checks"] == {"rows": 0, "nulls_v": 0, "nulls_who": 0}


def test_transform_metrics_and_write_are_one_job(spark, tmp_path, source):
    pipeline = Pipeline(spark).add_source(source).add_transformer({"type": "filter", "condition": "id > 3"}, {"type": "quality", "rules": [{"name": "v", "column": "v", "kind": "range", "params": {"max": 15}}]}).add_sink({"type": "file", "path": str(tmp_path / "one")})
    pipeline.plan()
    found = []
    assert jobs(spark, lambda: found.append(pipeline.run())) <= 2  # reading the footers and the write
    assert found[0][0].rows == 12


def test_pipeline_combines_sources(spark, tmp_path, source):
    names = spark.createDataFrame([("u1", "Ada")], "who string, name string")
    done = []
    p = Pipeline(spark).add_source(source, "events").add_source(names, "names").combine_with(lambda f: f["events"].join(f["names"], "who")).add_sink({"type": "table", "path": str(tmp_path / "a")}).add_sink({"type": "file", "path": str(tmp_path / "b")}).persist().on_completion(done.append)
    assert [m.rows for m in p.run()] == [5, 5] and len(done) == 1
    with pytest.raises(ValueError):
        Pipeline(spark).add_source(names).add_source(names).plan()
    with pytest.raises(ValueError):
        Pipeline(spark).plan()


def test_specs_are_checked():
    with pytest.raises(ValueError, match="needs source"):
        PipelineSpec.of({"pipeline_id": "x", "target": {"path": "p"}})
    with pytest.raises(ValueError, match="unknown entries"):
        PipelineSpec.of({"pipeline_id": "x", "source": {"a": 1}, "target": {"path": "p"}, "color": "red"})
    with pytest.raises(ValueError, match="mode"):
        PipelineSpec.of({"pipeline_id": "x", "source": {"a": 1}, "target": {"path": "p"}, "mode": "sometimes"})


def test_increments(spark, tmp_path):
    src = str(tmp_path / "src")
    spec = {"pipeline_id": "inc", "mode": "incremental", "source": {"type": "file", "path": src}, "target": {"type": "table", "path": str(tmp_path / "out")}, "incremental": {"watermark_column": "at", "keys": ["k"], "op_column": "op"}, "state_path": str(tmp_path / "state")}
    put = lambda data: spark.createDataFrame(data, "k int, v string, at int, op string").write.mode("append").parquet(src)
    put([(1, "a", 1, "I"), (2, "b", 2, "I"), (2, "c", 3, "U")])
    assert run(spark, spec)["watermark"] == "3"
    table = TableStore(spark, str(tmp_path / "out"))
    assert rows(table.read().select("k", "v")) == [(1, "a"), (2, "c")]
    assert run(spark, spec)["rows"] == 0
    put([(1, None, 10, "D"), (3, "d", 9, None)])
    assert run(spark, spec) | {"seconds": 0} and rows(table.read().select("k", "v")) == [(2, "c"), (3, "d")]
    assert json.loads((tmp_path / "state" / "inc.json").read_text())["watermark"] == "10"
    assert "_op_delete" not in table.read().columns
    (tmp_path / "state" / "inc.json").unlink()
    assert run(spark, spec)["rows"] >= 0  # the watermark comes from the table again


def test_watermarks_compare_by_type(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (2, 9, 10, 11)], "n int").write.parquet(str(tmp_path / "n"))
    df = spark.read.parquet(str(tmp_path / "n"))
    assert rows(beyond(df, "n", "9")) == [(10,), (11,)] and rows(beyond(df, "n", "9", True)) == [(10,), (11,), (9,)]
    assert "GreaterThan(n,9)" in beyond(df, "n", "9")._jdf.queryExecution().executedPlan().toString()
    assert beyond(df, "n", None) is df


def test_soft_deletes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    ops_ = lambda data: spark.createDataFrame(data, "k int, v string, op string")
    merge_changes(store, ops_([(1, "a", "I"), (2, "b", "I")]), ["k"], "op", soft_delete=True)
    merge_changes(store, ops_([(1, "gone", "D"), (2, "B", "U"), (3, "c", "D")]), ["k"], "op", soft_delete=True)
    assert rows(store.read()) == [(1, "a", True), (2, "B", False), (3, "c", True)]


def stream_spec(tmp_path, source, **more):
    schema = {"id": "long", "who": "string", "v": "double"}
    return {"pipeline_id": "s", "source": source | {"format": "parquet", "schema": schema}, "target": {"type": "table", "path": str(tmp_path / "out")}, "trigger": {"type": "available_now"}, "checkpoint_location": str(tmp_path / "ck")} | more


def test_stream_restarts_and_counts_each_batch_once(spark, tmp_path, source):
    spec = stream_spec(tmp_path, source, transforms=[{"type": "filter", "condition": "id >= 5"}])
    assert watch(start(spark, spec))["rows"] == 20
    spark.createDataFrame([(100, "new", 1.0)], "id long, who string, v double").write.mode("append").parquet(source["path"])
    assert watch(start(spark, spec))["rows"] == 1
    assert TableStore(spark, str(tmp_path / "out")).read().count() == 16


def test_streaming_runner_and_failures(spark, tmp_path, source):
    spec = stream_spec(tmp_path, source)
    streaming = {k: spec.pop(k) for k in ("trigger", "checkpoint_location")}
    assert run(spark, spec | {"mode": "streaming", "streaming": streaming})["rows"] == 20
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        bad = {"pipeline_id": "bad", "target": {"type": "table", "path": str(tmp_path / "bad")}, "checkpoint_location": str(tmp_path / "ck2"), "transforms": [{"type": "with", "columns": {"x": "assert_true(id < 3)", "y": "id / (id - id)"}}]}
        watch(start(spark, stream_spec(tmp_path, source) | bad))
    assert stop_all(spark) == 0


def test_late_rows_fall_behind_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    put = lambda times: spark.createDataFrame([(t,) for t in times], "t string").selectExpr("timestamp(t) AS ts").coalesce(1).write.mode("append").parquet(path)
    spec = {"pipeline_id": "late", "source": {"type": "file", "format": "parquet", "path": path, "schema": {"ts": "timestamp"}}, "target": {"type": "table", "path": str(tmp_path / "out")}, "trigger": {"type": "available_now"}, "checkpoint_location": str(tmp_path / "ck"), "transforms": [{"type": "watermark", "column": "ts", "threshold": "10 minutes"}, {"type": "aggregate", "metrics": [{"type": "count", "column": "*", "alias": "n"}], "window": {"column": "ts", "duration": "1 hour"}}]}
    put(["2024-01-01 00:10:00", "2024-01-01 02:30:00"])
    watch(start(spark, spec))
    put(["2024-01-01 00:20:00", "2024-01-01 05:00:00"])
    watch(start(spark, spec))
    out = TableStore(spark, str(tmp_path / "out")).read()
    assert sorted((str(r["window_start"]), r["n"]) for r in out.collect()) == [("2024-01-01 00:00:00", 1), ("2024-01-01 02:00:00", 1)]


def test_stream_specs_are_checked(spark, tmp_path, source):
    grouped = [{"type": "aggregate", "metrics": [{"type": "count", "alias": "n"}], "group_by": ["who"]}]
    with pytest.raises(ValueError, match="watermark"):
        start(spark, stream_spec(tmp_path, source, transforms=grouped))
    with pytest.raises(ValueError, match="trigger"):
        triggered(None, {"type": "now and then"})
    with pytest.raises(ValueError, match="schema"):
        start(spark, stream_spec(tmp_path, {"type": "file", "path": source["path"]}) | {"source": {"type": "file", "format": "parquet", "path": source["path"]}})


def test_sessions_and_stream_dedup_on_batches(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 03:00:00")], "k string, t string").selectExpr("k", "timestamp(t) AS t")
    out = ops.session_aggregate(df, "t", "10 minutes", ["k"], [{"type": "count", "alias": "n"}])
    assert sorted(r["n"] for r in out.collect()) == [1, 2]
    assert ops.stream_deduplicate(df, ["k"]).count() == 1


def test_config_and_cli(spark, tmp_path, capsys):
    spec = {"pipeline_id": "c", "source": {"type": "file", "path": str(tmp_path / "x")}, "target": {"type": "table", "path": str(tmp_path / "y")}}
    for name in ("s.yaml", "s.json"):
        config.save(spec, tmp_path / name)
        assert config.load(tmp_path / name) == spec
    assert cli.main(["validate", str(tmp_path / "s.yaml")]) == 0
    config.save({"pipeline_id": "c"}, tmp_path / "bad.yaml")
    assert cli.main(["validate", str(tmp_path / "bad.yaml")]) == 1
    assert cli.main(["generate", str(tmp_path / "s.yaml"), "--out", str(tmp_path / "made.py")]) == 0
    compile((tmp_path / "made.py").read_text(), "made.py", "exec")
    assert subprocess.run([sys.executable, "-m", "millrace.cli", "--help"], capture_output=True, check=False).returncode == 0


def test_spec_of_a_table():
    table = Table("users", [Column("id", "BIGINT"), Column("updated_at", "TIMESTAMP")], ["id"])
    spec = spec_of_table(table, "jdbc:derby:memory:x", "/data")
    assert PipelineSpec.of(spec) and spec["target"]["merge_keys"] == ["id"] and spec["transforms"][0]["keep"] == "latest_timestamp"
    assert "users_copy" in pipeline_source(spec)


def test_an_increment_whose_rows_all_go_moves_the_watermark(spark, tmp_path, source):
    spec = {"pipeline_id": "none", "mode": "incremental", "source": source, "target": {"type": "table", "path": str(tmp_path / "none")}, "incremental": {"watermark_column": "id", "keys": ["id"]}, "transforms": [{"type": "filter", "condition": "false"}], "state_path": str(tmp_path / "state")}
    out = run(spark, spec)
    assert (out["rows"], out["watermark"], out["status"]) == (0, "19", "success")
    assert run(spark, spec | {"transforms": []})["rows"] == 0
