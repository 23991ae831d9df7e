import json
import threading

import pytest
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions import camel_case, camel_case_column, snake_case, snake_case_column
from millrace.operators import joins
from millrace.runners.base import Runner, State
from millrace.plans.spec import PipelineSpec
from millrace.sinks import sink_for
from millrace.streaming import ops
from millrace.streaming.run import start, watch
from millrace.tables.store import ConflictError, TableStore

NAMES = {"orderID": "order_id", "HTTPServer": "http_server", "getHTTPCode2x": "get_http_code2x", "a1B": "a1_b", "already_snake": "already_snake", "X": "x", "": "", "ABC": "abc", "End Of": "end _of"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_as_text_and_as_columns(spark):
    assert {n: snake_case(n) for n in NAMES} == NAMES
    df = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", snake_case_column(F.col("n")).alias("s")).collect()} == NAMES | {None: None}
    camel = {"order_id": "orderId", "http_server_name": "httpServerName", "x": "x", "_a": "A", "a__b": "aB", "aB_cD": "aBCd", "": ""}
    assert {n: camel_case(n) for n in camel} == camel
    df = spark.createDataFrame([(n,) for n in camel], "n string")
    assert {r["n"]: r["c"] for r in df.select("n", camel_case_column(F.col("n")).alias("c")).collect()} == camel


def test_a_file_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "deep" / "f.json")
    assert storage.read_text(spark, path) is None
    assert storage.write_text(spark, path, "one", overwrite=False) and not storage.write_text(spark, path, "two", overwrite=False)
    assert storage.read_text(spark, path) == "one"
    assert storage.write_text(spark, path, "thrée") and storage.read_text(spark, path) == "thrée"
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(storage.write_text(spark, path + ".x", str(k), overwrite=False))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(won) == 1
    assert sorted(p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")) == ["f.json", "f.json.x"]


def test_a_writer_that_dies_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "t"))
    store.write(spark.range(5).toDF("k"))
    monkeypatch.setattr(storage.os, "link", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write(spark.range(3).toDF("k"))
    monkeypatch.undo()
    assert store.versions() == [0] and store.read().count() == 5
    assert len(store.vacuum(0)) == 1 and store.read().count() == 5
    store.write(spark.range(2).toDF("k"))
    assert store.read().count() == 7


def test_replace_and_delete_rewrite_only_what_they_must(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(k, f"p {k % 5}=x", k * 10) for k in range(50)] + [(None, "p 0=x", None)], "k int, p string, v int")
    store.write(df.coalesce(1), partition_by=["p"])
    before = set(store._files(*store.manifest()["parts"]))
    assert len(before) == 5
    store.replace_where(spark.createDataFrame([(1000, "p 1=x", 1)], df.schema), "p = 'p 1=x'")
    now = store.manifest()
    assert now["metrics"]["files_rewritten"] == 1 and len(before & set(store._files(*now["parts"]))) == 4 and now["rows"] == store.read().count() == 42
    store.delete_where("v >= 0 AND p = 'p 2=x'")
    assert store.manifest()["metrics"]["files_rewritten"] == 1 and store.manifest()["rows"] == store.read().count() == 32
    store.delete_where("k = 77777")
    assert store.manifest()["metrics"]["files_rewritten"] == 0 and store.read().count() == 32
    store.delete_where("v > 100")
    want = [(k, f"p {k % 5}=x", k * 10) for k in range(50) if k % 5 not in (1, 2) and k * 10 <= 100] + [(None, "p 0=x", None), (1000, "p 1=x", 1)]
    assert rows(store.read().select("k", "p", "v")) == sorted(want, key=repr)
    base = store.manifest()
    store.write(spark.createDataFrame([(5, "p 0=x", 5)], df.schema))
    with pytest.raises(ConflictError):
        store._commit(store._entry(base, "x", store.read().schema, [], [], 0))


def test_state_is_kept_where_spark_can_write(spark, tmp_path):
    state = State(spark, f"file://{tmp_path}/s", "p")
    assert state.load() == {}
    state.save(watermark="3")
    state.save(runs=2)
    assert json.loads((tmp_path / "s" / "p.json").read_text()) == {"watermark": "3", "runs": 2} == state.load()
    State(spark, None, "p").save(a=1)


def test_runs_that_append_are_not_repeated(spark):
    class Failing(Runner):
        calls = 0

        def _run(self, spec):
            Failing.calls += 1
            raise RuntimeError("not now")

    for mode, calls in (("append", 1), ("overwrite", 3)):
        Failing.calls = 0
        with pytest.raises(RuntimeError):
            Failing(spark).run(PipelineSpec("p", {"type": "file"}, {"type": "table", "path": "x", "mode": mode}, max_retries=2, retry_delay=0.0))
        assert Failing.calls == calls
    assert sink_for(spark, {"type": "kafka", "bootstrap_servers": "h:1", "topic": "t"}).config.max_retries == 0


def test_asof_slices_by_itself_when_sides_are_large(spark, monkeypatch):
    left = spark.createDataFrame([(k % 3, k * 7 % 100) for k in range(200)], "k int, t int")
    right = spark.createDataFrame([(k % 3, k * 5 % 100, k) for k in range(60)], "k int, t int, v int")
    want = rows(joins.asof_join(left, right, "k", "t", "t", ["v"]))
    monkeypatch.setattr(joins, "SLICE_BYTES", 200)
    assert joins._slice_length(left, "t", right, "t") < 50
    assert rows(joins.asof_join(left, right, "k", "t", "t", ["v"])) == want
    with pytest.raises(ValueError, match="range join"):
        joins.range_join(left, right.selectExpr("t AS lo", "t + 1 AS hi"), "t", "lo", "hi", 10, "full_outer")


def test_steps_that_need_batches_run_on_each(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda data: spark.createDataFrame(data, "k int, at int").coalesce(1).write.mode("append").parquet(src)
    latest = {"type": "deduplicate", "keys": ["k"], "keep": "latest_timestamp", "timestamp": "at"}
    spec = {"pipeline_id": "b", "source": {"type": "file", "format": "parquet", "path": src, "schema": {"k": "int", "at": "int"}}, "transforms": [{"type": "filter", "condition": "k > 0"}, latest, {"type": "limit", "n": 100}], "target": {"type": "table", "path": str(tmp_path / "out"), "merge_keys": ["k"]}, "trigger": {"type": "available_now"}, "checkpoint_location": str(tmp_path / "ck")}
    put([(0, 1), (1, 1), (1, 5), (1, 3), (2, 2)])
    watch(start(spark, spec))
    put([(1, 9), (1, 8)])
    watch(start(spark, spec))
    assert rows(TableStore(spark, str(tmp_path / "out")).read()) == [(1, 9), (2, 2)]
    with pytest.raises(ValueError, match="whole batches"):
        start(spark, spec | {"target": {"type": "file", "path": str(tmp_path / "f")}})
    assert [len(x) for x in ops.split_steps(spec["transforms"])] == [1, 2]
    assert ops.needs_batch({"type": "quality", "rules": [{"name": "u", "column": "k", "kind": "unique"}]}) and not ops.needs_batch({"type": "quality", "rules": []})


def test_stream_joins_refuse_what_cannot_be_kept(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        ops.join_static(stream, spark.range(3), ["value"], "full_outer")
    with pytest.raises(ValueError):
        ops.join_streams(stream, stream, ["value"], "timestamp", "timestamp", "'0 hours'", "'1 hour'", "full_outer")


def test_shared_folder_on_a_cluster_must_be_named(spark):
    class Context:
        master = "spark://h:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
