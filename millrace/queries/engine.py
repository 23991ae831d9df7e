"""What sources, sinks, tables and runners do besides reading and writing rows."""

from __future__ import annotations

import http.server
import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import helpers, metadata, types
from millrace.functions import camel_case_column
from millrace.functions.extend import register_aggregate, register_table_function
from millrace.operators import aggregate, masking, project, schema
from millrace.plans.codegen import pipeline_source
from millrace.queries.masks import _PEOPLE, _people
from millrace.queries.registry import query, scratch, table
from millrace.runners import run
from millrace.sinks import Sink, sink_for
from millrace.sources import files, jdbc, read
from millrace.tables.store import TableStore


def _rows(spark: SparkSession, data: Sequence[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(list(data), columns)


def _file(sf_dir: str, name: str) -> dict:
    return {"type": "file", "path": f"{sf_dir}/{name}.parquet"}


def _derby(spark: SparkSession, name: str) -> dict:
    return {"type": "jdbc", "url": f"jdbc:derby:memory:{name}{abs(hash(scratch(spark, name)))};create=true"}


def _refused(call: Callable[[], object], kind: type[Exception] = ValueError) -> bool:
    try:
        call()
    except kind:
        return True
    return False


# sources


@query("SELECT n_nationkey, n_name FROM nation")
def scan_jdbc_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three strides of a database table, read side by side."""
    spec = _derby(spark, "strides")
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("K"), F.col("n_name").alias("NAME"))
    sink_for(spark, spec | {"table": "NATIONS", "mode": "overwrite"}).write(df)
    back = read(spark, spec | {"table": "NATIONS", "partition_column": "K", "lower_bound": 0, "upper_bound": 25, "num_partitions": 3, "fetchsize": 10})
    return back.select(F.col("K").cast("int").alias("n_nationkey"), F.col("NAME").alias("n_name"))


@query("SELECT * FROM (VALUES ('K', 'BIGINT', true), ('NAME', 'VARCHAR', false)) t(name, kind, key)")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and keys of a database, from its metadata."""
    spec = _derby(spark, "catalog")
    jdbc.execute(spark, spec, "CREATE TABLE THINGS (K BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(20))")
    found = metadata.extract(spark, spec).tables["THINGS"]
    return _rows(spark, [(c.name, c.type, c.name in found.primary_keys) for c in found.columns], "name string, kind string, key boolean")


@query("SELECT true AS there, false AS absent")
def connection_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(jdbc.works(spark, _derby(spark, "there")), jdbc.works(spark, {"url": "jdbc:derby:memory:absent"}))], "there boolean, absent boolean")


@query("SELECT DISTINCT o_orderstatus FROM orders")
def file_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a partition column, from the folders' names."""
    path = scratch(spark, "parts")
    sink_for(spark, {"type": "file", "path": path, "partition_by": ["o_orderstatus"]}).write(table(spark, sf_dir, "orders"))
    return files.partitions(read(spark, {"type": "file", "path": path}), ["o_orderstatus"])


@query("SELECT CAST(1 AS BIGINT) AS files, true AS some_bytes, 6 AS formats")
def file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "size")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(path)
    found = files.estimate_size(spark, path)
    return _rows(spark, [(found["files"], found["bytes"] == found["mean_bytes"] > 0, len(files.FORMATS))], "files long, some_bytes boolean, formats int")


class _Pages(http.server.BaseHTTPRequestHandler):
    """Serves lists of records in pages of ten, refuses every third request, and keeps what is posted."""

    records: list = []
    posted: list = []
    asked = 0

    def log_message(self, *_: object) -> None:
        pass

    def _answer(self, code: int, body: object = None) -> None:
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self) -> None:
        type(self).asked += 1
        if type(self).asked % 3 == 0:
            return self._answer(503)
        at = int(self.path.partition("at=")[2] or 0)
        after = f"/list?at={at + 10}" if at + 10 < len(self.records) else None
        return self._answer(200, {"data": {"items": self.records[at : at + 10]}, "next": after})

    def do_POST(self) -> None:
        type(self).posted += json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self._answer(200)


def _server(records: list) -> tuple[str, type[_Pages]]:
    handler = type("Pages", (_Pages,), {"records": records, "posted": [], "asked": 0})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}", handler


@query("SELECT n_nationkey, n_name FROM nation")
def scan_rest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A REST endpoint page by page, refused requests tried again. It answers on this machine alone."""
    url, _ = _server([r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()])  # 25 rows
    spec = {"type": "api", "url": f"{url}/list", "schema": {"n_nationkey": "int", "n_name": "string"}, "records_path": "data.items", "pagination": {"next_page_path": "next"}, "retry_delay": 0.01}
    return read(spark, spec)


# sinks


class _Failing(Sink):
    def _write(self, df: DataFrame) -> None:
        raise RuntimeError("no room")


@query("SELECT n_nationkey, 'no room' AS _error_message FROM nation")
def sink_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a write that failed, set aside with the error."""
    path = scratch(spark, "set-aside")
    _Failing({"max_retries": 0, "on_error": "quarantine", "quarantine_path": path}).write(table(spark, sf_dir, "nation").select("n_nationkey"))
    return spark.read.parquet(path).filter("_quarantine_timestamp IS NOT NULL").drop("_quarantine_timestamp")


@query("SELECT 'skipped' AS on_skip, true AS on_fail, true AS no_columns, true AS twice, true AS unknown_mode")
def sink_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region")
    skipped = _Failing({"max_retries": 0, "on_error": "skip"}).write(df).status
    failed = _refused(lambda: _Failing({"max_retries": 1, "retry_delay": 0.0}).write(df), RuntimeError)
    checks = [_refused(lambda bad=bad: _Failing({}).write(bad)) for bad in (df.select(), df.selectExpr("r_name", "r_name AS R_NAME"))]
    return _rows(spark, [(skipped, failed, *checks, _refused(lambda: sink_for(spark, {"type": "file", "path": "x", "mode": "sometimes"})))], "on_skip string, on_fail boolean, no_columns boolean, twice boolean, unknown_mode boolean")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 4")
def sink_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook before the write drops rows, one behind it fails and is logged, and the rows are counted."""
    path = scratch(spark, "hooks")
    sink = sink_for(spark, {"type": "file", "path": path, "validate": True, "rebalance": True})
    sink.before.append(lambda df: df.filter("n_nationkey > 4"))
    sink.after.append(lambda m: 1 / 0)
    written = sink.write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).rows
    return read(spark, {"type": "file", "path": path}).filter(F.lit(written == 20))


@query("SELECT c_custkey, c_name FROM customer")
def sink_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed and sorted table of the catalogue, and the files that make it up."""
    path = scratch(spark, "buckets")
    name = f"buckets_{abs(hash(path))}"
    sink = sink_for(spark, {"type": "file", "table": name, "path": path, "bucket_by": ["c_custkey"], "buckets": 4, "sort_by": ["c_custkey"], "mode": "overwrite"})
    sink.write(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    listed = sink.list_output_files()
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path).filter(F.lit(len(listed) >= 4))


@query("SELECT n_nationkey, n_name FROM nation")
def sink_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four posted as JSON; the result is what arrived."""
    url, handler = _server([])
    sink_for(spark, {"type": "api", "url": f"{url}/in", "batch_size": 4, "retry_delay": 0.01}).write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in handler.posted], "n_nationkey int, n_name string")


# projections, masks, schemas, names


@query(f"SELECT c_custkey, CASE WHEN length(card) < 4 THEN repeat('*', length(card)) ELSE '**** **** **** ' || right(card, 4) END AS card FROM {_PEOPLE}")
def mask_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several ways of a partial mask the first that the rule names holds; a missing column is left out."""
    rules = {"card": {"strategy": "partial_mask", "visible_start": 2, "preserve_area_code": True, "visible_digits": 4}, "absent": {"strategy": "hash"}}
    return masking.mask(_people(spark, sf_dir), rules).select("c_custkey", "card")


@query("SELECT n_nationkey, 'daily' AS _pipeline_id, true AS stamped FROM nation")
def provenance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.with_provenance(table(spark, sf_dir, "nation"), "daily").select("n_nationkey", "_pipeline_id", F.col("_processed_at").isNotNull().alias("stamped"))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def drop_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.apply_steps(table(spark, sf_dir, "nation"), [{"type": "with", "columns": {"_temp": "1"}}, {"type": "drop", "columns": ["_temp", "n_name"]}]).select("n_nationkey", "n_regionkey")


@query("SELECT * FROM (VALUES ('step', true), ('aggregate', true), ('mask', true), ('source', true), ('sink', true), ('driver', true)) t(what, refused)")
def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no part of the engine knows is an error everywhere."""
    df = table(spark, sf_dir, "region")
    calls = {
        "step": lambda: project.apply_step(df, {"type": "dance"}),
        "aggregate": lambda: aggregate.aggregate(df, ["r_name"], {"mode": ["r_regionkey"]}),
        "mask": lambda: masking.mask(df, {"r_name": {"strategy": "paint"}}),
        "source": lambda: read(spark, {"type": "fax"}),
        "sink": lambda: sink_for(spark, {"type": "fax"}),
        "driver": lambda: types.driver_of("jdbc:nothing://h"),
    }
    return _rows(spark, [(k, _refused(f)) for k, f in calls.items()], "what string, refused boolean")


@query("SELECT * FROM (VALUES ('missing', 'size'), ('extra', 'n_regionkey'), ('type', 'n_name: expected int, found string'), ('equal', 'true')) t(what, which)")
def schema_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "nation").schema
    expected = T.StructType([found["n_nationkey"], T.StructField("n_name", T.IntegerType()), T.StructField("size", T.LongType())])
    diff = schema.difference(expected, found)
    told = [("missing", c) for c in diff.missing] + [("extra", c) for c in diff.extra] + [("type", f"{c}: expected {a}, found {b}") for c, (a, b) in diff.types.items()]
    return _rows(spark, [*told, ("equal", str(schema.compare(found, found)).lower())], "what string, which string")


@query(
    """SELECT n_nationkey, array_to_string(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN k = 1 THEN w[k] ELSE upper(w[k][1]) || lower(w[k][2:]) END), '') AS name
    FROM (SELECT n_nationkey, string_split('nation_' || n_name || '_x', '_') AS w FROM nation)"""
)
def camel_case_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", camel_case_column(F.concat(F.lit("nation_"), "n_name", F.lit("_x"))).alias("name"))


@query(
    """SELECT * FROM (VALUES ('NUMBER(9)', 'int'), ('NUMBER(10)', 'bigint'), ('NUMBER(19)', 'decimal(19,0)'), ('NUMBER', 'decimal(38,18)'), ('NUMBER(12,3)', 'decimal(12,3)'),
    ('VARCHAR2(9)', 'string'), ('DATE', 'timestamp')) t(name, kind)"""
)
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["NUMBER(9)", "NUMBER(10)", "NUMBER(19)", "NUMBER", "NUMBER(12,3)", "VARCHAR2(9)", "DATE"]
    return _rows(spark, [(n, types.spark_type(n, "oracle").simpleString()) for n in names], "name string, kind string")


@query("SELECT * FROM (VALUES ('id', 'bigint'), ('updated_at', 'timestamp'), ('updated_at_year', 'int')) t(col_name, data_type)")
def ddl_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated CREATE TABLE, run, and the columns of what it made."""
    name = f"dated_{abs(hash(scratch(spark, 'ddl')))}"
    spark.sql(types.create_table(types.Table(name, [types.Column("id", "BIGINT"), types.Column("updated_at", "TIMESTAMP")])))
    found = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]
    spark.sql(f"DROP TABLE {name}")
    return _rows(spark, found, "col_name string, data_type string")


@query("SELECT '1,2|3,4|5' AS chunks, 'b' AS missing, '1,3' AS kept, 'INTEGER' AS kind")
def helper_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = "|".join(",".join(map(str, c)) for c in helpers.chunked(range(1, 6), 2))
    kept = helpers.deduplicated([{"k": "a", "v": 1}, {"k": "a", "v": 2}, {"k": "b", "v": 3}], "k")
    kind = types.sql_types(types.infer_types({"x": 1}))["x"]
    return _rows(spark, [(chunks, ",".join(helpers.check_keys({"a": 1}, ["a", "b"])), ",".join(str(r["v"]) for r in kept), kind)], "chunks string, missing string, kept string, kind string")


@query("SELECT p_size, round(exp(avg(ln(p_partkey + 1))), 4) AS mean FROM part GROUP BY 1")
def udaf_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of the user's own."""

    def mean(values):
        import numpy as np

        return float(np.exp(np.log(values).mean()))

    made = register_aggregate(spark, "geometric_mean", mean)
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.round(made(F.col("p_partkey") + 1.0), 4).alias("mean"))


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS at, n_name[i] AS letter FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def udtf_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of the user's own."""
    register_table_function(spark, "letters", lambda text: enumerate(text, 1), "at int, letter string")
    table(spark, sf_dir, "nation").createOrReplaceTempView("udtf_nation")
    return spark.sql("SELECT n_nationkey, at, letter FROM udtf_nation, LATERAL letters(n_name)")


@query("SELECT o_custkey, min(o_totalprice) AS o_totalprice_first, max(o_totalprice) AS o_totalprice_last FROM orders GROUP BY 1")
def agg_first_last_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an order first and last go by the value, so that they do not depend on how rows lie."""
    return aggregate.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], {"first": ["o_totalprice"], "last": ["o_totalprice"]})


# tables and runners


@query("SELECT CAST(1 AS BIGINT) AS version, count(*) * 2 AS numRows, 'n_regionkey' AS partitions FROM nation")
def tbl_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, scratch(spark, "detail"))
    for _ in range(2):
        store.write(table(spark, sf_dir, "nation"), partition_by=["n_regionkey"])
    d = store.detail()
    return _rows(spark, [(d["version"], d["numRows"], ",".join(d["partitionColumns"]))], "version long, numRows long, partitions string")


@query("SELECT n_nationkey, n_name FROM nation")
def tbl_merge_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge makes the table if there is none, and refuses a source that has a key twice."""
    store, df = TableStore(spark, scratch(spark, "fresh")), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    store.merge(df, ["n_nationkey"])
    refused = _refused(lambda: store.merge(df.union(df), ["n_nationkey"]))
    return store.read().filter(F.lit(refused))


@query("SELECT count(*) FILTER (n_regionkey <> 1) AS rows, CAST(1 AS BIGINT) AS rewritten FROM nation")
def tbl_delete_one_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the files that hold a row in question are written anew."""
    store = TableStore(spark, scratch(spark, "pruned"))
    store.write(table(spark, sf_dir, "nation").coalesce(1), partition_by=["n_regionkey"])
    store.delete_where("n_regionkey = 1")
    return _rows(spark, [(store.read().count(), store.manifest()["metrics"]["files_rewritten"])], "rows long, rewritten long")


def _batch(spark: SparkSession, sf_dir: str, name: str, **more) -> tuple[dict, str]:
    root = scratch(spark, name)
    spec = {"pipeline_id": name, "source": _file(sf_dir, "nation"), "target": {"type": "table", "path": f"{root}/out", "mode": "overwrite"}, "state_path": f"{root}/state"}
    return run(spark, spec | more), f"{root}/out"


@query("SELECT * FROM (VALUES (0, 'overwrite'), (1, 'optimize')) t(version, operation)")
def batch_optimizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is compacted behind every load."""
    _, path = _batch(spark, sf_dir, "tidy", optimize_every=1, z_order=["n_nationkey"])
    return TableStore(spark, path).history().select(F.col("version").cast("int").alias("version"), "operation")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS nulls_n_name, count(*) - count(DISTINCT n_regionkey) AS duplicates, 'success' AS status FROM nation")
def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that checks what it loads, and the metrics that it gives to callbacks."""
    found, _ = _batch(spark, sf_dir, "checked", validation={"required": ["n_name"], "keys": ["n_regionkey"]})
    return _rows(spark, [(*(found["checks"][k] for k in ("rows", "nulls_n_name", "duplicates")), found["status"])], "rows long, nulls_n_name long, duplicates long, status string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 9")
def generated_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script that is generated for a spec holds that spec, and running it gives the table."""
    root = scratch(spark, "generated")
    spec = {"pipeline_id": "made", "source": _file(sf_dir, "nation"), "transforms": [{"type": "filter", "condition": "n_nationkey < 9"}, {"type": "select", "columns": ["n_nationkey", "n_name"]}], "target": {"type": "table", "path": root, "mode": "overwrite"}}
    names: dict = {"__name__": "made"}
    exec(compile(pipeline_source(spec), "made.py", "exec"), names)  # our own text
    run(spark, names["SPEC"])
    return read(spark, {"type": "table", "path": root})


@query("SELECT max(n_nationkey) AS watermark, CAST(0 AS BIGINT) AS second, CAST(count(*) AS BIGINT) AS first FROM nation")
def incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark is kept in the shared folder; a second run finds nothing new."""
    root = scratch(spark, "state")
    spec = {"pipeline_id": "state", "mode": "incremental", "source": _file(sf_dir, "nation"), "target": {"type": "table", "path": f"{root}/out"}, "incremental": {"watermark_column": "n_nationkey", "keys": ["n_nationkey"]}, "state_path": f"{root}/state"}
    first, second = run(spark, spec), run(spark, spec)
    return _rows(spark, [(int(second["watermark"]), second["rows"], first["rows"])], "watermark int, second long, first long")
