import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import quality
from millrace.operators.quality import Rule

# Parcels on their way: some without a weight, with a code that is none, or bound for nowhere.
PARCELS = [
    (100, "AB-12", 3.5, "north", 2),
    (101, "AB-13", None, "south", 1),
    (102, "ab-14", 0.2, "north", None),
    (103, None, 7.0, "moon", 4),
    (104, "ZZ-99", 61.0, "east", 3),
    (105, "", -1.0, "west", 0),
    (106, "CD-01", 12.0, "south", 5),
]
CODE = Rule("code", "code", "pattern", {"pattern": "^[A-Z]{2}-[0-9]{2}$"})
RULES = [
    Rule("weighed", "weight", "not_null"),
    Rule("bearable", "weight", "range", {"min": 0.1, "max": 30}),
    CODE,
    Rule("bound", "region", "in_list", {"values": ["north", "south", "east", "west"]}),
    Rule("few", "pieces", "range", {"max": 4}, severity="warning"),
    Rule("sane", None, "custom", {"check": "coalesce(weight, 0) * coalesce(pieces, 1) < 100"}),
]
FAILED = {100: [], 101: ["weighed", "bearable"], 102: ["code"], 103: ["code", "bound"], 104: ["bearable", "sane"], 105: ["bearable", "code"], 106: []}


@pytest.fixture(scope="module")
def parcels(spark):
    return spark.createDataFrame(PARCELS, "id int, code string, weight double, region string, pieces int").cache()


def test_each_row_names_the_rules_it_fails(parcels):
    seen = quality.evaluate(parcels, RULES).collect()
    assert {r["id"]: r["_failed_rules"] for r in seen} == FAILED
    assert sorted(r["id"] for r in seen if r["_warnings"]) == [102, 106]


def test_one_pass_splits_and_counts(parcels, spark, tmp_path):
    valid, invalid = quality.split(parcels, RULES)
    assert valid.columns == parcels.columns
    assert sorted(r["id"] for r in valid.collect()) == [k for k, v in FAILED.items() if not v]
    m = quality.metrics(parcels, RULES).first()
    assert (m["total"], m["valid"], m["invalid"]) == (7, 2, 5) and abs(m["score"] - 200 / 7) < 1e-9
    assert (m["failed_code"], m["failed_bearable"], m["failed_few"]) == (3, 3, 2)
    assert quality.metrics(parcels.filter("id < 0"), RULES).first()["score"] == 0.0
    quality.quarantine(invalid, str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    assert back.count() == 5 and back.filter("_quarantine_timestamp IS NULL").count() == 0


def test_a_warning_never_removes_a_row(parcels):
    soft = [Rule("w", "weight", "not_null", severity="warning"), Rule("p", "pieces", "range", {"min": 3}, "warning")]
    assert quality.split(parcels, soft)[0].count() == len(PARCELS)


def test_what_null_means(parcels):
    assert quality.split(parcels, [CODE])[0].count() == 4
    lenient = Rule("code", "code", "pattern", CODE.params, null_policy="pass")
    assert quality.split(parcels, [lenient])[0].count() == 5
    assert quality.split(parcels, [Rule("w", "weight", "not_null", null_policy="pass")])[0].count() == 6


def test_uniqueness_has_a_stated_survivor(spark, monkeypatch):
    rows = [(k, f"v{k % 4}" if k % 5 else None, k // 7) for k in range(60)] + [(0, None, 0)] * 3
    df = spark.createDataFrame(rows, "k int, v string, n int")
    for salts in (1, 64):
        monkeypatch.setattr(quality, "SALTS", salts)
        kept = quality.split(df, [Rule("u", "v", "unique", {"order": ["n DESC", "k"]})])[0].collect()
        want = {v: min(((-n, k) for k, w, n in rows if w == v)) for v in {r[1] for r in rows}}
        assert {r["v"]: (-r["n"], r["k"]) for r in kept} == want and len(kept) == 5
    free = Rule("u", "v", "unique")
    a = sorted(quality.split(df, [free])[0].collect(), key=repr)
    assert a == sorted(quality.split(df.repartition(7).orderBy("n"), [free])[0].collect(), key=repr) and len(a) == 5
    both = quality.evaluate(df, [Rule("one", "v", "unique"), Rule("two", "n", "unique", severity="warning")])
    assert both.columns == ["k", "v", "n", "_failed_rules", "_warnings"]


def test_other_kinds(parcels):
    ids = lambda rule: sorted(r["id"] for r in quality.split(parcels, [rule])[0].collect())
    assert ids(Rule("l", "code", "length", {"min_length": 1, "max_length": 5})) == [100, 101, 102, 104, 106]
    assert ids(Rule("f", "pieces", "custom", {"check": lambda c: c % 2 == 0})) == [100, 103, 105]
    for wrong in ({"kind": "astrology"}, {"severity": "fatal"}, {"null_policy": "shrug"}):
        with pytest.raises(ValueError):
            Rule(**({"name": "x", "column": "id", "kind": "not_null"} | wrong))


def test_check(parcels):
    assert quality.check(parcels, ["code", "weight"], ["region"]) == {"rows": 7, "nulls_code": 1, "nulls_weight": 1, "duplicates": 2}
    assert quality.check(parcels.limit(0), ["code"], ["region"]) == {"rows": 0, "nulls_code": 0, "duplicates": 0}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("xy. ", max_size=4)), st.one_of(st.none(), st.integers(-3, 9))), max_size=8))
def test_no_row_is_lost_or_doubled(spark, data):
    df = spark.createDataFrame(data, "s string, n int")
    rules = [Rule("dot", "s", "regex", {"pattern": "[.]"}), Rule("top", "n", "range", {"max": 5}), Rule("short", "s", "length", {"max_length": 2}, "warning")]
    valid, invalid = quality.split(df, rules)
    assert sorted(map(tuple, valid.collect() + invalid.drop("_failed_rules").collect()), key=repr) == sorted(data, key=repr)
