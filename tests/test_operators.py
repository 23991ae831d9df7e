import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import camel_case, camel_case_column, parse_timestamp, snake_case, snake_case_column
from millrace.operators import aggregate, casting, dedup, joins, project, schema, sets, window


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def sales(spark):
    data = [("a", 1, 10.0), ("a", 2, None), ("b", 1, 5.0), ("b", 1, 5.0), (None, 3, 1.0)]
    return spark.createDataFrame(data, "k string, n int, v double").cache()


def test_steps(sales):
    steps = [{"type": "filter", "condition": "n < 3"}, {"type": "with", "columns": {"w": "n * 2"}}, {"type": "rename", "mapping": {"v": "value"}}, {"type": "cast", "mapping": {"n": "string"}}, {"type": "drop", "columns": ["k"]}, {"type": "order", "columns": ["-w", "value"]}, {"type": "limit", "n": 2}]
    out = project.apply_steps(sales, steps)
    assert out.columns == ["n", "value", "w"] and out.first()["w"] == 4 and out.count() == 2
    with pytest.raises(ValueError, match="unknown step"):
        project.apply_step(sales, {"type": "fly"})
    assert project.with_provenance(sales, "p").first()["_pipeline_id"] == "p"


def test_strict_cast_fails(spark):
    df = spark.createDataFrame([("x",)], "c string")
    assert project.cast_columns(df, {"c": "int"}).first()["c"] is None
    with pytest.raises(Exception):  # noqa: B017
        project.cast_columns(df, {"c": "int"}, strict=True).collect()


def test_aggregates(sales):
    out = aggregate.aggregate(sales, ["k"], {"sum": ["v", "absent"], "count_distinct": ["n"], "collect_list": ["v"], "collect_set": ["v"]})
    assert rows(out) == [("a", 10.0, 2, [10.0], [10.0]), ("b", 10.0, 1, [5.0, 5.0], [5.0]), (None, 1.0, 1, [1.0], [1.0])]
    assert rows(aggregate.aggregate(sales, [], {"count": ["v"]})) == [(4,)]
    with pytest.raises(ValueError, match="nothing"):
        aggregate.aggregate(sales, [], {"sum": ["absent"]})
    with pytest.raises(ValueError, match="unknown aggregate"):
        aggregate.aggregate(sales, [], {"mode": ["v"]})


def test_first_and_last_by_order(sales):
    out = aggregate.aggregate(sales.filter("k = 'a'"), ["k"], {"first": ["n"], "last": ["n"]}, order=["n"])
    assert rows(out) == [("a", 1, 2)]


def test_hierarchies_tell_totals_from_nulls(sales):
    out = {(r["k"], r["grouping_id"]): r["n_count"] for r in aggregate.rollup(sales, ["k"], {"count": ["n"]}, True).collect()}
    assert out == {("a", 0): 2, ("b", 0): 2, (None, 0): 1, (None, 1): 5}
    assert aggregate.cube(sales, ["k", "n"], {"count": ["v"]}).count() == 4 + 3 + 3 + 1
    with pytest.raises(ValueError, match="no columns"):
        aggregate.rollup(sales, ["z"], {"count": ["n"]})


def test_pivot_unpivot_percentiles(sales):
    out = aggregate.pivot(sales, ["k"], "n", "v", "sum", [1, 2])
    assert out.columns == ["k", "1", "2"]
    back = aggregate.unpivot(out.filter("k = 'b'"), ["k"], ["1", "2"])
    assert rows(back) == [("b", "1", 10.0), ("b", "2", None)]
    p = aggregate.percentiles(sales, [], "v", [0.29, 0.5, 0.999], exact=True)
    assert p.columns == ["v_p29", "v_p50", "v_p99_9"] and p.first()["v_p50"] == 5.0


def test_null_and_duplicate_counts_on_empty(sales):
    assert rows(aggregate.null_counts(sales, ["k", "v"])) == [(1, 1)]
    assert rows(aggregate.duplicate_count(sales, ["k"])) == [(5, 3, 2)]
    assert rows(aggregate.duplicate_count(sales.limit(0), ["k"])) == [(0, 0, 0)]


def test_windows(sales):
    out = window.window_aggregates(sales, ["k"], {"count_distinct": ["n"], "max": ["v"]})
    assert {r["n_count_distinct_window"] for r in out.filter("k = 'a'").collect()} == {2}
    ranked = window.ranks(sales, ["k"], ["n", F.col("v").desc()], ntile=2)
    assert {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"} <= set(ranked.columns)


def test_dedup(sales, spark):
    assert dedup.deduplicate(sales).count() == 4
    assert rows(dedup.deduplicate(sales, ["k"], "first", ["n"]).select("k", "n")) == [("a", 1), ("b", 1), (None, 3)]
    assert rows(dedup.deduplicate(sales, ["k"], "last", ["n"]).select("k", "n")) == [("a", 2), ("b", 1), (None, 3)]
    assert dedup.deduplicate(sales, ["k"]).count() == 3
    dated = spark.createDataFrame([(1, None, "old"), (1, 5, "b"), (1, 5, "a")], "k int, t int, x string")
    assert rows(dedup.deduplicate(dated, ["k"], "latest_timestamp", timestamp="t", ties=["x"])) == [(1, 5, "a")]
    once = dedup.deduplicate(dated, ["k"], "latest_timestamp", timestamp="t", ties=["x"])
    assert rows(dedup.deduplicate(once, ["k"], "latest_timestamp", timestamp="t")) == rows(once)
    with pytest.raises(ValueError):
        dedup.deduplicate(dated, ["k"], "latest_timestamp")


def test_top_per_group_limits_before_the_shuffle(sales):
    plan = dedup.top_per_group(sales, ["k"], [F.asc("n")], 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (2, "r")], "k int, m string")
    assert rows(joins.equi_join(a, b, ["k"])) == [(1, "x", "p")]
    assert rows(joins.equi_join(a, b, ["k"], null_safe=True)) == [(1, "x", "p"), (None, "y", "q")]
    assert joins.estimated_bytes(a) > 0
    assert "BroadcastHashJoin" in a.join(joins.broadcast_if_small(spark.range(3).selectExpr("int(id) AS k")), "k")._jdf.queryExecution().executedPlan().toString()
    assert a.alias("s").join(b.alias("t"), joins.key_condition("s", "t", [])).count() == 0


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, 5, "l1"), (1, 1, "l2"), (2, 9, "l3")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k int, t int, y string")
    out = joins.asof_join(left, right, "k", "t", "t", ["y"])
    assert rows(out.select("x", "asof_y", "asof_t")) == [("l1", "b", 5), ("l2", None, None), ("l3", None, None)]
    import random

    rnd = random.Random(1)
    many = [(rnd.randrange(3), rnd.randrange(200), i) for i in range(120)]
    a, b = (spark.createDataFrame(m, "k int, t int, x int") for m in (many[:60], many[60:]))
    want = rows(joins.asof_join(a, b.withColumnRenamed("x", "y"), "k", "t", "t", ["y"]))
    for every in (7, 50, 1000):
        assert rows(joins.asof_join(a, b.withColumnRenamed("x", "y"), "k", "t", "t", ["y"], every=every)) == want
    points = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (-3.0,), (None,)], "p double")
    spans = spark.createDataFrame([("u", 0.0, 10.0), ("v", 9.95, 30.0), ("w", -5.0, -2.0), ("none", 5.0, 1.0)], "n string, a double, b double")
    assert rows(joins.range_join(points, spans, "p", "a", "b", 4.0).select("p", "n")) == [(-3.0, "w"), (0.0, "u"), (10.0, "u"), (10.0, "v"), (9.9, "u")]


def test_range_join_of_wide_and_narrow_ranges(spark):
    import random

    rnd = random.Random(5)
    points = [(i, rnd.choice([rnd.uniform(-50, 50), float(rnd.randrange(-9, 9)), rnd.uniform(-1e6, 1e6)])) for i in range(150)] + [(900, None), (901, 1e300), (902, 3.0), (903, 3.0)]
    spans = [(f"s{i}", a, a + rnd.choice([0.0, 1.0, 7.5, 64.0, 65.0, 5e3, 1e6])) for i, a in enumerate(rnd.uniform(-100, 100) for _ in range(60))]
    spans += [("all", float("-inf"), float("inf")), ("up", 1e5, float("inf")), ("far", 0.0, 1e301), ("null", None, 4.0), ("back", 4.0, 2.0)]
    p, s = spark.createDataFrame(points, "id int, x double"), spark.createDataFrame(spans, "n string, a double, b double")
    for kept in (spans, [v for v in spans if v[0] not in ("all", "far")], [v for v in spans if v[0] in ("s1", "s2")], []):
        s = spark.createDataFrame(kept, "n string, a double, b double")
        pairs = {(i, n) for i, x in points for n, a, b in kept if None not in (x, a, b) and a <= x <= b}
        hit = {i for i, _ in pairs}
        got = lambda how, *columns: rows(joins.range_join(p, s, "x", "a", "b", 4.0, how).select(*columns))
        missed = [i for i, _ in points if i not in hit]
        assert got("inner", "id", "n") == sorted(pairs, key=repr)
        assert got("left", "id", "n") == sorted([*pairs, *((i, None) for i in missed)], key=repr)
        assert got("left_semi", "id") == sorted(((i,) for i in hit), key=repr)
        assert got("left_anti", "id") == sorted(((i,) for i in missed), key=repr)


def test_a_wide_range_stays_few_rows(spark):
    assert [r["_level"] for r in spark.createDataFrame([(0.0, 3.0), (0.0, 16.0), (0.0, 17.0), (0.0, 4096.0), (0.0, 1e30)], "a double, b double").select(joins._level("a", "b", 1.0).alias("_level")).collect()] == [0, 0, 1, 2, -1]


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2], [1, 3]))
    assert rows(sets.intersect(a, b, True)) == [(1,)] and rows(sets.difference(a, b, True)) == [(1,), (2,)]
    assert rows(sets.union_distinct(a, b)) == [(1,), (2,), (3,)]
    assert sets.union_all(a, b.withColumnRenamed("x", "y"), missing_as_null=True).columns == ["x", "y"]


def test_casting(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "c string")
    assert rows(casting.cast(df, {"c": "int", "absent": "int"})) == [(1,), (None,), (None,)]
    assert rows(casting.conversions(df, {"c": "int"})) == [(1, 1)]
    with pytest.raises(ValueError, match="'c': 1"):
        casting.cast(df, {"c": "int"}, "fail")


def test_schema_modes(spark):
    df = spark.createDataFrame([("7", 1)], "a string, b int")
    expected = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.DateType())])
    out = schema.validate(df, expected, "evolve")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("a", "int"), ("c", "date"), ("b", "int")]
    assert rows(out) == [(7, None, 1)]
    for mode in ("strict", "add_columns"):
        with pytest.raises(ValueError, match="schema differs"):
            schema.validate(df, expected, mode)
    hard = T.StructType([T.StructField("a", T.StringType(), False), T.StructField("b", T.IntegerType())])
    with pytest.raises(ValueError, match="nullability"):
        schema.validate(df, hard)
    assert schema.validate(df, hard, ignore_nullability=True) is df
    with pytest.raises(ValueError, match="missing"):
        schema.require(df, ["z"])
    assert str(schema.difference(expected, df.schema)).startswith("missing ['c']; extra ['b']")


def test_text_and_dates(spark):
    names = ["camelCase", "HTTPServer", "already_snake", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(snake_case_column(F.col("n"))).collect()] == [snake_case(n) for n in names]
    df = spark.createDataFrame([("one_two_three",), ("one",)], "n string")
    assert [r[0] for r in df.select(camel_case_column(F.col("n"))).collect()] == [camel_case(n) for n in ("one_two_three", "one")]
    texts = ["2024-01-05", "2024/01/05", "05-01-2024", "05/01/2024", "2024-01-05 00:00:00", "2024-01-05T00:00:00", "2024-01-05 00:00:00.000000"]
    df = spark.createDataFrame([(t,) for t in [*texts, "soon", None]], "t string")
    assert [str(r[0]) for r in df.select(parse_timestamp(F.col("t"))).collect()] == ["2024-01-05 00:00:00"] * 7 + ["None"] * 2
