"""Structured Streaming. Each query reads the events as a stream until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.queries.registry import query, scratch, table
from millrace.sources import read_stream
from millrace.streaming import ops
from millrace.streaming.run import start, to_table, watch
from millrace.tables.store import TableStore

_N = [{"type": "count", "column": "*", "alias": "n"}]


def _events(spark: SparkSession, sf_dir: str) -> dict:
    """A stream of the one file of events among the tables."""
    schema = table(spark, sf_dir, "events").schema
    return {"type": "file", "format": "parquet", "path": sf_dir, "schema": schema, "options": {"pathGlobFilter": "events.parquet"}}


def _run(spark: SparkSession, sf_dir: str, name: str, steps: list, mode: str = "append", **target) -> str:
    root = scratch(spark, name)
    spec = {"pipeline_id": name, "source": _events(spark, sf_dir), "transforms": steps, "target": {"type": "table", "path": f"{root}/out"} | target, "output_mode": mode, "trigger": {"type": "available_now"}, "checkpoint_location": f"{root}/checkpoint"}
    watch(start(spark, spec))
    return f"{root}/out"


def _text(column: str, name: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50")
def stream_append_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"type": "filter", "condition": "event_type = 'click' AND value > 50"}, {"type": "select", "columns": ["event_id", "value"]}]
    return TableStore(spark, _run(spark, sf_dir, "pass", steps)).read()


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n FROM w, m WHERE s + INTERVAL 1 HOUR <= mark"""
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: windows come out once the watermark has passed their end."""
    steps = [{"type": "watermark", "column": "ts", "threshold": "10 minutes"}, {"type": "aggregate", "group_by": ["event_type"], "metrics": _N, "window": {"column": "ts", "duration": "1 hour"}}]
    return TableStore(spark, _run(spark, sf_dir, "tumbling", steps)).read().select(_text("window_start", "window_start"), "event_type", "n")


@query(
    """WITH k AS (SELECT unnest([0, 1]) AS i), e AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS s FROM events, k)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM e GROUP BY 1"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode into memory, then as a table."""
    root = scratch(spark, "sliding")
    df = ops.transform(spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir), [{"type": "watermark", "column": "ts", "threshold": "10 minutes"}])
    made = ops.window_aggregate(df, "ts", "1 hour", [], _N, "30 minutes")

    def replace(batch: DataFrame, number: int) -> None:
        TableStore(batch.sparkSession, f"{root}/out").write(batch, "overwrite", transaction=("sliding", number))

    watch(made.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return TableStore(spark, f"{root}/out").read().select(_text("window_start", "window_start"), "n")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of two hours; those come out that the watermark has closed."""
    steps = [{"type": "watermark", "column": "ts", "threshold": "10 minutes"}, {"type": "session", "column": "ts", "gap": "2 hours", "group_by": ["user_id"], "metrics": _N}]
    return TableStore(spark, _run(spark, sf_dir, "session", steps)).read().select("user_id", _text("session_start", "session_start"), "n")


@query("SELECT user_id, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def stream_join_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their customers; the stream's rows are counted in the table that they came to."""
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    steps = [{"type": "select", "columns": ["event_id", "user_id"]}, {"type": "join", "table": customers, "keys": ["user_id"]}]
    return TableStore(spark, _run(spark, sf_dir, "static", steps)).read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT a.event_id, b.event_id AS follow_id FROM events a JOIN events b USING (user_id)
    WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR"""
)
def stream_join_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of the same user in the two hours behind them, both as streams."""
    root = scratch(spark, "join")

    def side(kind: str) -> DataFrame:
        events = read_stream(spark, _events(spark, sf_dir)).filter(F.col("event_type") == kind)
        return ops.watermark(events, "ts", "10 minutes").select("user_id", "event_id", "ts")

    right = side("purchase").withColumnsRenamed({"event_id": "follow_id", "ts": "follow_ts"})
    both = ops.join_streams(side("click"), right, ["user_id"], "ts", "follow_ts", "'0 hours'", "'2 hours'").select("event_id", "follow_id")
    writer = to_table(both, f"{root}/out", "join").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
    watch(writer.trigger(availableNow=True).start())
    return TableStore(spark, f"{root}/out").read()


_MIDDLE = "2024-01-15 12:30:00"


@query(
    f"""WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{_MIDDLE}'), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM e GROUP BY 1),
    m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n FROM w, m WHERE s + INTERVAL 1 HOUR <= mark"""
)
def stream_watermark_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one stream: the rows of the second lie behind the watermark of the first and are dropped."""
    root = scratch(spark, "late")
    events = table(spark, sf_dir, "events")
    steps = [{"type": "watermark", "column": "ts", "threshold": "10 minutes"}, {"type": "aggregate", "metrics": _N, "window": {"column": "ts", "duration": "1 hour"}}]
    source = {"type": "file", "format": "parquet", "path": f"{root}/in", "schema": events.schema}
    for late in (False, True):
        events.filter((F.col("ts") < F.lit(_MIDDLE).cast("timestamp_ntz")) == late).write.mode("append").parquet(f"{root}/in")
        watch(start(spark, {"pipeline_id": "late", "source": source, "transforms": steps, "target": {"type": "table", "path": f"{root}/out"}, "trigger": {"type": "available_now"}, "checkpoint_location": f"{root}/checkpoint"}))
    return TableStore(spark, f"{root}/out").read().select(_text("window_start", "window_start"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_stateful_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom stateful operator: running counts of each type, the latest of each merged into a table."""
    root = scratch(spark, "stateful")
    counts = ops.count_by_key(read_stream(spark, _events(spark, sf_dir)), "event_type")
    writer = to_table(counts, f"{root}/out", "stateful", ["event_type"]).outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
    watch(writer.trigger(availableNow=True).start())
    return TableStore(spark, f"{root}/out").read()


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1")
def stream_latest_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that need whole batches: the latest row of each user, merged by user."""
    steps = [{"type": "select", "columns": ["user_id", "ts"]}, {"type": "deduplicate", "keys": ["user_id"], "keep": "latest_timestamp", "timestamp": "ts"}, {"type": "order", "columns": ["user_id"]}]
    return TableStore(spark, _run(spark, sf_dir, "latest", steps, merge_keys=["user_id"])).read().select("user_id", _text("ts", "latest"))


@query("SELECT count(*) AS rows, true AS stopped FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What watching a query counts, and that none is left."""
    query_ = read_stream(spark, _events(spark, sf_dir)).writeStream.format("noop").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    seen = watch(query_)
    return spark.createDataFrame([(seen["rows"], not query_.isActive)], "rows long, stopped boolean")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark outlasts the data, so each user comes out once."""
    steps = [{"type": "watermark", "column": "ts", "threshold": "60 days"}, {"type": "deduplicate", "keys": ["user_id"]}, {"type": "select", "columns": ["user_id"]}]
    return TableStore(spark, _run(spark, sf_dir, "dedup", steps)).read()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_foreach_batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts merged into a table by key."""
    root = scratch(spark, "merge")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writer = to_table(counts, f"{root}/out", "counts", ["event_type"]).outputMode("update")
    watch(writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return TableStore(spark, f"{root}/out").read()


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is run twice from one checkpoint; the second run adds nothing."""
    root = scratch(spark, "restart")
    spec = {"pipeline_id": "restart", "source": _events(spark, sf_dir), "target": {"type": "table", "path": f"{root}/out"}, "trigger": {"type": "available_now"}, "checkpoint_location": f"{root}/checkpoint"}
    watch(start(spark, spec))
    watch(start(spark, spec))
    return TableStore(spark, f"{root}/out").read().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
