"""Masks and tokens. Emails, cards and phones come from names and keys by the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import masking as ops
from millrace.queries.registry import query, scratch, table


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pad = lambda n: F.lpad(key.cast("string"), n, "0")
    name: Column = F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "."))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, F.lit("ab@x.org")).when(key % 10 == 2, F.lit("plain")).otherwise(F.concat(name, F.lit("@mail.org"))).alias("email"),
        F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, F.lit("12")).otherwise(F.concat(F.lit("4111-1111 "), pad(8))).alias("card"),
        F.when(key % 10 == 0, F.lit(None)).when(key % 10 == 1, F.lit("555-0101")).when(key % 10 == 2, F.concat(F.lit("+1 "), pad(10))).otherwise(F.concat(F.lit("("), pad(3), F.lit(") 555-0100"))).alias("phone"),
    )


_PEOPLE = """(SELECT c_custkey, c_name,
    CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'ab@x.org' WHEN c_custkey % 10 = 2 THEN 'plain' ELSE lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@mail.org' END AS email,
    CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '12' ELSE '4111-1111 ' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS card,
    CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '555-0101' WHEN c_custkey % 10 = 2 THEN '+1 ' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') ELSE '(' || lpad(CAST(c_custkey AS VARCHAR), 3, '0') || ') 555-0100' END AS phone
    FROM customer)"""


def _masked(spark: SparkSession, sf_dir: str, column: str, **rule) -> DataFrame:
    return ops.mask(_people(spark, sf_dir), {column: rule}).select("c_custkey", column)


@query(f"SELECT c_custkey, '**********' AS email FROM {_PEOPLE}")
def mask_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "email", strategy="full_mask")


@query(
    f"""SELECT c_custkey, CASE WHEN instr(email, '@') = 0 THEN email WHEN instr(email, '@') <= 3 THEN repeat('*', instr(email, '@') - 1) || substr(email, instr(email, '@'))
    ELSE email[1] || repeat('*', instr(email, '@') - 3) || substr(email, instr(email, '@') - 1) END AS email FROM {_PEOPLE}"""
)
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "email", strategy="partial_mask", preserve_domain=True)


@query(f"SELECT c_custkey, CASE WHEN length(card) < 4 THEN repeat('*', length(card)) ELSE '**** **** **** ' || right(card, 4) END AS card FROM {_PEOPLE}")
def mask_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "card", strategy="partial_mask", visible_digits=4)


@query(
    f"""SELECT c_custkey, CASE WHEN phone IS NULL THEN NULL WHEN phone LIKE '(%' THEN left(phone, 5) || ' ***-****' WHEN phone LIKE '+1%' THEN '+1 (' || substr(phone, 4, 3) || ') ***-****'
    ELSE repeat('*', length(phone)) END AS phone FROM {_PEOPLE}"""
)
def mask_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "phone", strategy="partial_mask", preserve_area_code=True)


@query(f"SELECT c_custkey, CASE WHEN length(c_name) <= 5 THEN c_name ELSE left(c_name, 3) || repeat('#', length(c_name) - 5) || right(c_name, 2) END AS c_name FROM {_PEOPLE}")
def mask_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "c_name", strategy="partial_mask", visible_start=3, visible_end=2, mask_char="#")


@query("SELECT sha256(CAST(c_custkey AS VARCHAR) || 'pepper') AS c_custkey, c_name FROM customer")
def mask_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mask(_people(spark, sf_dir), {"c_custkey": {"strategy": "hash", "salt": "pepper"}}).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, md5(email) AS email FROM {_PEOPLE}")
def mask_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "email", strategy="hash", algorithm="md5")


@query(f"SELECT c_custkey, '[REDACTED]' AS phone FROM {_PEOPLE}")
def mask_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "phone", strategy="redact")


@query(f"SELECT c_custkey, CASE WHEN card IS NOT NULL THEN 'XXXX-' || right(card, 4) END AS card FROM {_PEOPLE}")
def mask_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mask(_people(spark, sf_dir), [{"column": "card", "strategy": "pattern", "pattern": "XXXX-$4"}]).select("c_custkey", "card")


@query(f"SELECT count(*) AS rows, count(email) AS email_values, count(*) FILTER (contains(email, '@')) AS email_masked, count(phone) AS phone_values, count(*) AS phone_masked FROM {_PEOPLE}")
def mask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.metrics(_people(spark, sf_dir), {"email": {"strategy": "partial_mask", "preserve_domain": True}, "phone": {"strategy": "redact"}})


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grown in two steps, and kept as files between."""
    people, path = _people(spark, sf_dir), scratch(spark, "vault")
    ops.grow_vault(people.filter("c_custkey % 2 = 0"), "email").write.parquet(f"{path}/1")
    ops.grow_vault(people, "email", spark.read.parquet(f"{path}/1")).write.parquet(f"{path}/2")
    return spark.read.parquet(f"{path}/2")


@query(
    f"""WITH p AS {_PEOPLE}, e AS (SELECT email, min(c_custkey % 2) AS step FROM p WHERE email IS NOT NULL GROUP BY 1),
    t AS (SELECT email, 'TOKEN_' || lpad(CAST(row_number() OVER (ORDER BY step, encode(email)) AS VARCHAR), 8, '0') AS token FROM e)
    SELECT c_custkey, token AS email FROM p LEFT JOIN t USING (email)"""
)
def mask_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tokenize(_people(spark, sf_dir), "email", _vault(spark, sf_dir)).select("c_custkey", "email")


@query(f"SELECT c_custkey, email FROM {_PEOPLE}")
def mask_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = _vault(spark, sf_dir)
    return ops.detokenize(ops.tokenize(_people(spark, sf_dir), "email", vault), "email", vault).select("c_custkey", "email")


@query()
def mask_format_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "card", strategy="format_preserve", key="k")


@query(f"SELECT c_custkey, card, card IS NOT NULL AS hidden FROM {_PEOPLE}")
def mask_encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions import masks

    key = "0123456789abcdef"
    coded = _people(spark, sf_dir).withColumn("code", ops.mask_column(F.col("card"), {"strategy": "encrypt", "encryption_key": key}))
    return coded.select("c_custkey", masks.decrypted(F.col("code"), key).alias("card"), F.coalesce(F.col("code") != F.col("card"), F.lit(False)).alias("hidden"))
