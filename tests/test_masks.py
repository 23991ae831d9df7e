import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import masks
from millrace.operators import masking

EDGES = [None, "", "a@b", "ab@x.y", "abc@x@y", "plain", "john.doe@email.com", "@x", "1234-5678 9012 3456", "12", "378282246310005", "(555) 123-4567", "+1 555 123 4567", "555-0101"]


def masked(spark, values, **rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["v"] for r in masking.mask(df, {"v": rule}).orderBy("i").collect()]


def email(v):
    if not v or "@" not in v:
        return v
    local, _, rest = v.partition("@")
    return ("*" * len(local) if len(local) <= 2 else local[0] + "*" * (len(local) - 2) + local[-1]) + "@" + rest


def card(v, n=4):
    if not v:
        return v
    d = v.replace(" ", "").replace("-", "")
    if len(d) < n:
        return "*" * len(d)
    m = "*" * (len(d) - n) + d[len(d) - n :]
    return " ".join(m[i : i + 4] for i in range(0, len(m), 4))


def phone(v):
    if not v:
        return v
    d = re.sub(r"\D", "", v)
    if len(d) == 10:
        return f"({d[:3]}) ***-****"
    return f"+{d[0]} ({d[1:4]}) ***-****" if len(d) == 11 else "*" * len(v)


def test_partial_masks_on_edges(spark):
    assert masked(spark, EDGES, strategy="partial_mask", preserve_domain=True) == [email(v) for v in EDGES]
    assert masked(spark, EDGES, strategy="partial_mask", visible_digits=4) == [card(v) for v in EDGES]
    assert masked(spark, EDGES, strategy="partial_mask", preserve_area_code=True) == [phone(v) for v in EDGES]
    want = [v if v is None or len(v) <= 5 else v[:2] + "*" * (len(v) - 5) + v[-3:] for v in EDGES]
    assert masked(spark, EDGES, strategy="partial_mask", visible_start=2, visible_end=3) == want
    assert masked(spark, ["4111111111111111"], strategy="partial_mask", visible_digits=0) == ["**** **** **** ****"]


def test_constant_masks_and_hashes(spark):
    assert masked(spark, [None, "x"], strategy="FULL_MASK", mask_length=3) == ["***", "***"]
    assert masked(spark, [None, "x"], strategy="full_mask", keep_null=True) == [None, "*" * 10]
    assert masked(spark, [None, "x"], strategy="redact") == ["[REDACTED]"] * 2
    import hashlib

    assert masked(spark, [None, "x"], strategy="hash", salt="s") == [None, hashlib.sha256(b"xs").hexdigest()]
    assert masked(spark, ["123-45-6789", None], strategy="pattern", pattern="XXX-XX-$4") == ["XXX-XX-6789", None]
    with pytest.raises(ValueError, match="unknown masking"):
        masked(spark, ["x"], strategy="rot13")


def test_format_preserving(spark):
    values = [*EDGES, "Abc-123 é"]
    a, b = (masked(spark, values, strategy="format_preserve", key=k) for k in ("one", "two"))
    assert a == masked(spark, values, strategy="format_preserve", key="one") and a != b
    shape = lambda v: v and "".join("0" if c in "0123456789" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in v)
    assert [shape(v) for v in a] == [shape(v) for v in values]


def test_encryption(spark):
    df = spark.createDataFrame([("secret",), (None,)], "v string").withColumn("c", masks.encrypted(F.col("v"), "0123456789abcdef"))
    assert [r[0] for r in df.select(masks.decrypted(F.col("c"), "0123456789abcdef")).collect()] == ["secret", None]


def test_tokens_go_on_from_the_vault(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    vault = masking.grow_vault(df, "v", prefix="ID")
    assert {r["value"]: r["token"] for r in vault.collect()} == {"a": "ID_00000001", "b": "ID_00000002"}
    more = spark.createDataFrame([(f"c{i}",) for i in range(50)] + [("a",)], "v string")
    grown = masking.grow_vault(more, "v", vault, prefix="ID").collect()
    assert sorted(r["number"] for r in grown) == list(range(1, 53)) and len({r["token"] for r in grown}) == 52
    tokens = masking.tokenize(df, "v", vault)
    assert sorted(r["v"] or "" for r in tokens.collect()) == ["", "ID_00000001", "ID_00000002", "ID_00000002"]
    assert sorted(r["v"] or "" for r in masking.detokenize(tokens, "v", vault).collect()) == ["", "a", "b", "b"]
    strange = spark.createDataFrame([("ID_9",)], "v string")
    assert masking.detokenize(strange, "v", vault).first()["v"] == "ID_9"


def test_masks_stay_native_and_let_filters_through(spark, tmp_path):
    spark.range(10).selectExpr("id", "concat('u', id, '@x.org') AS v").write.parquet(str(tmp_path / "p"))
    out = masking.mask(spark.read.parquet(str(tmp_path / "p")), {"v": {"strategy": "partial_mask", "preserve_domain": True}}).filter("id > 5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "GreaterThan(id,5)" in plan


def test_missing_columns(spark):
    df = spark.range(1)
    assert masking.mask(df, {"z": {"strategy": "redact"}}).columns == ["id"]
    with pytest.raises(ValueError, match="no column"):
        masking.mask(df, {"z": {"strategy": "redact"}}, strict=True)
