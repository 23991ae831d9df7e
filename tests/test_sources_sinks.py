import http.server
import json
import threading

import pytest

from millrace import metadata
from millrace.functions import kafka_columns, parse_json_columns
from millrace.retry import retried
from millrace.sinks import Sink, SinkConfig, sink_for
from millrace.sources import files, jdbc, kafka, read, read_stream, rest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_files_come_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, 'quo"te', None)], "k int, s string, v double")
    sink = sink_for(spark, {"type": "file", "format": kind, "path": str(tmp_path / kind), "mode": "overwrite", "validate": True})
    assert sink.write(df).rows == 2
    assert rows(read(spark, {"type": "file", "format": kind, "path": str(tmp_path / kind), "schema": {"k": "int", "s": "string", "v": "double"}})) == rows(df)
    assert sink.list_output_files() and files.estimate_size(spark, str(tmp_path / kind))["files"] >= 1


def test_partitioned_and_bucketed_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g{i % 2}") for i in range(10)], "k int, g string")
    sink_for(spark, {"type": "file", "path": str(tmp_path / "p"), "partition_by": ["g"], "compression": "zstd", "rebalance": True}).write(df)
    back = read(spark, {"type": "file", "path": str(tmp_path / "p")})
    assert rows(files.partitions(back, ["g"])) == [("g0",), ("g1",)]
    sink_for(spark, {"type": "file", "table": "bucketed", "path": str(tmp_path / "b"), "bucket_by": ["k"], "buckets": 4, "sort_by": ["k"], "mode": "overwrite"}).write(df)
    joined = spark.table("bucketed").hint("merge").join(spark.table("bucketed").withColumnRenamed("g", "h"), "k")
    assert joined.count() == 10 and "Exchange hashpartitioning(k" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed")


def test_unknown_kinds(spark):
    for call in (lambda: read(spark, {"type": "fax"}), lambda: read_stream(spark, {"type": "fax"}), lambda: sink_for(spark, {"type": "fax"}), lambda: read(spark, {"type": "file", "format": "fax", "path": "x"}), lambda: SinkConfig(mode="sometimes"), lambda: read(spark, {"type": "jdbc", "url": "jdbc:derby:memory:x"})):
        with pytest.raises(ValueError):
            call()


def test_jdbc_round_trip_and_metadata(spark):
    url = "jdbc:derby:memory:shop;create=true"
    spec = {"type": "jdbc", "url": url}
    jdbc.execute(spark, spec, "CREATE TABLE ITEMS (ID BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(20) NOT NULL, PRICE DECIMAL(10,2) DEFAULT 1)", "CREATE INDEX BYNAME ON ITEMS (NAME)")
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "ID long, NAME string")
    sink = sink_for(spark, spec | {"table": "ITEMS", "validate": True})
    assert sink.write(df).rows == 20
    whole = read(spark, spec | {"table": "ITEMS", "partition_column": "ID", "lower_bound": 0, "upper_bound": 20, "num_partitions": 3})
    assert whole.rdd.getNumPartitions() == 3 and whole.count() == 20
    part = read(spark, spec | {"query": "SELECT ID FROM ITEMS WHERE ID < 5", "partition_column": "ID", "upper_bound": 5, "num_partitions": 2})
    assert part.count() == 5
    assert jdbc.works(spark, spec) and not jdbc.works(spark, {"url": "jdbc:derby:memory:absent"})
    found = metadata.extract(spark, spec, ["items"]).tables["ITEMS"]
    assert found.primary_keys == ["ID"] and [c.name for c in found.columns] == ["ID", "NAME", "PRICE"]
    assert found.struct("derby").simpleString() == "struct<ID:bigint,NAME:string,PRICE:decimal(10,2)>"
    assert any(i["columns"] == ["NAME"] and not i["unique"] for i in found.indexes)
    made = sink_for(spark, spec | {"table": "MADE"})
    made.create_table(df, ["ID"])
    assert made.write(df).rows == 20


class Handler(http.server.BaseHTTPRequestHandler):
    posted: list = []
    failures = 0

    def log_message(self, *args):
        pass

    def _answer(self, code, body=b"{}"):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if Handler.failures:
            Handler.failures -= 1
            return self._answer(503)
        if self.headers.get("Authorization") != "Basic dTpw":
            return self._answer(401)
        page = int(dict(p.split("=") for p in self.path.partition("?")[2].split("&") if "=" in p).get("page", 1))
        data = {"data": {"items": [{"id": page * 10 + k, "tags": ["x"], "more": {"a": k}} for k in range(2)]}, "next": f"/list?page={page + 1}" if page < 3 else None}
        self._answer(200, json.dumps(data).encode())

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if Handler.failures:
            Handler.failures -= 1
            return self._answer(500)
        Handler.posted.append((self.headers.get("Idempotency-Key"), json.loads(body), self.headers.get("X-API-Key")))
        self._answer(200)


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_rest_source_follows_pages_and_tries_again(spark, server):
    Handler.failures = 2
    spec = {"type": "api", "url": f"{server}/list", "schema": {"id": "long", "tags": "array<string>", "more": "string"}, "records_path": "data.items", "pagination": {"next_page_path": "next"}, "auth": {"user": "u", "password": "p"}, "retry_delay": 0.01}
    got = read(spark, spec)
    assert sorted(r["id"] for r in got.collect()) == [10, 11, 20, 21, 30, 31]
    assert got.filter("id = 11").first()["more"] == '{"a": 1}' and got.first()["tags"] == ["x"]
    with pytest.raises(Exception, match="401"):
        read(spark, spec | {"auth": {}}).collect()
    assert rest.records_of({"a": {"b": 1}}, "a") == [{"b": 1}] and rest.records_of({}, "a") == []


def test_rest_pages_by_parameters(server):
    spec = {"url": f"{server}/list", "auth": {"user": "u", "password": "p"}, "params": {"page": 2}, "pagination": {"param_updates": {"page": "none.such"}}}
    assert len(list(rest.pages(spec))) == 1


def test_rest_sink_posts_batches_once(spark, server):
    Handler.failures, Handler.posted = 1, []
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k int, v string").coalesce(1)
    sink = sink_for(spark, {"type": "api", "url": f"{server}/in", "batch_size": 2, "auth": {"api_key": "s"}, "retry_delay": 0.01})
    assert sink.write(df).rows == 5
    assert [len(b) for _, b, _ in Handler.posted] == [2, 2, 1] and len({k for k, _, _ in Handler.posted}) == 3
    assert Handler.posted[0][1][0] == {"k": 0, "v": "v0"} and Handler.posted[0][2] == "s"


def test_kafka_projection_and_options(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(kafka_columns(df)) == [("1", '{"k":1,"v":"a"}')]
    assert rows(kafka_columns(df, "v", ["k"])) == [("a", '{"k":1}')]
    with pytest.raises(ValueError):
        kafka_columns(df, "z")
    raw = spark.createDataFrame([(bytearray(b'{"a": 1}'), 5), (bytearray(b"broken"), 6)], "value binary, offset long")
    assert rows(parse_json_columns(raw, "a int", keep=["offset"])) == [(1, 5), (None, 6)]
    found = kafka.options({"bootstrap_servers": "h:1", "topic": "t", "max_offsets_per_trigger": 10, "security_protocol": "SSL"})
    assert found["startingOffsets"] == "latest" and found["failOnDataLoss"] == "false" and found["maxOffsetsPerTrigger"] == "10" and found["kafka.security.protocol"] == "SSL"


def test_kafka_needs_its_jar(spark):
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
    except Exception:
        pytest.skip("no Kafka jar here: the connector itself is not exercised")


class Flaky(Sink):
    def __init__(self, config, failures):
        super().__init__(config)
        self.failures, self.calls = failures, 0

    def _write(self, df):
        self.calls += 1
        if self.calls <= self.failures:
            raise RuntimeError("not now")
        df.write.format("noop").mode("overwrite").save()


def test_sink_retries_hooks_and_errors(spark, tmp_path):
    df = spark.range(7).toDF("n")
    sink = Flaky({"retry_delay": 0.0}, 2)
    sink.before.append(lambda d: d.filter("n > 0"))
    seen = []
    sink.after += [seen.append, lambda m: 1 / 0]
    assert sink.write(df).rows == 6 and sink.calls == 3 and seen[0].status == "success"
    with pytest.raises(RuntimeError):
        Flaky({"max_retries": 0}, 1).write(df)
    assert Flaky({"max_retries": 0, "on_error": "skip"}, 1).write(df).status == "skipped"
    q = Flaky({"max_retries": 0, "on_error": "quarantine", "quarantine_path": str(tmp_path / "q")}, 1)
    assert q.write(df).status == "quarantined"
    assert set(spark.read.parquet(str(tmp_path / "q")).columns) == {"n", "_error_message", "_quarantine_timestamp"}
    for bad in (df.select(), df.selectExpr("n", "n AS N")):
        with pytest.raises(ValueError):
            Flaky({}, 0).write(bad)


def test_retry_stops_at_final_errors():
    calls = []

    def fail():
        calls.append(1)
        raise ValueError("wrong input")

    with pytest.raises(ValueError):
        retried(fail, 3, 0.0)
    assert len(calls) == 1


def test_ignore_writes_once_and_never_waits(spark, tmp_path):
    url = "jdbc:derby:memory:ignored;create=true"
    targets = [{"type": "file", "path": str(tmp_path / "f")}, {"type": "table", "path": str(tmp_path / "t")}, {"type": "jdbc", "url": url, "table": "kept"}]
    for target in targets:
        first = sink_for(spark, target | {"mode": "ignore"}).write(spark.range(3))
        again = sink_for(spark, target | {"mode": "ignore"}).write(spark.range(5))
        assert (first.rows, again.rows, again.status) == (3, 0, "success")
        assert sink_for(spark, target).count(spark.range(0)) == 3
