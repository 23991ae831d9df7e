"""Every operator and stage on one table of awkward rows: clashing columns, repeated and null ids, a text of a
megabyte, ties. Results are compared with those on the plain table, so the columns make no difference."""

import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import bpe, decontaminate, langid, licenses, quality, sharding, simhash, suffix, token_counts, toxicity
from millrace.llm.queries import tokenizer
from tests.llm.test_suffix import brute

CLASHES = ["_id", "_key", "_text_key", "row", "doc", "text_key", "group", "key", "at", "fp", "bucket", "name", "kept", "starts", "items", "n_words", "p_good", "shard", "slot", "token_ids", "score", "task", "class", "g", "set_key"]


def awkward():
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice(["ra", "te", "lo", "mi", "sun", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(n))
    base = [prose(120) for _ in range(6)]
    huge = prose(160_000)
    return [(k, t) for k, t in enumerate(base)] + [(1, base[1]), (1, "the same id with another text, quite short"), (None, base[2]), (None, "null id"), (None, None), (7, ""), (8, huge), (9, huge[: len(huge) // 2]), (10, base[0]), (10, base[0])]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(awkward(), "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(spark, plain):
    return plain.selectExpr("doc_id", "text", "'en' AS lang", "concat('d/', doc_id, '.txt') AS path", *[f"'{c}' AS `{c}`" for c in CLASHES])


def rows(df):
    return sorted(map(repr, df.collect()))


OPERATORS = {
    "licenses": lambda d: licenses.scan(d, path_col="doc_id"),
    "bpe": lambda d: bpe.encode(d, tokenizer("byte_bpe_50k.json"), decoded=True),
    "simhash": lambda d: simhash.near_duplicates(d).drop("group"),
    "simhash five": lambda d: simhash.near_duplicates(d, **corpus_pipeline.NEAR).drop("group"),
    "suffix": lambda d: suffix.remove_repeats(d),
    "quality": lambda d: quality.assess(d),
    "sharding": lambda d: sharding.pack(d, shards=3),
    "sharding by capacity": lambda d: sharding.pack(d, shards=None, capacity=5000).select("doc_id", "size", "text_crc32"),
    "token counts": lambda d: token_counts.token_counts(d, tokenizer("byte_bpe_50k.tiktoken")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_make_no_difference(plain, clashing, name):
    got = rows(OPERATORS[name](clashing))
    assert len(got) == len(awkward()) and got == rows(OPERATORS[name](plain))


def test_models_and_benchmarks(spark, plain, clashing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert rows(toxicity.scores(clashing, toxicity.fit(clashing, labels))) == rows(toxicity.scores(plain, toxicity.fit(plain, labels)))
    assert len(rows(langid.predictions(clashing, langid.fit(clashing)))) == len(awkward())
    bench = spark.createDataFrame([(1, awkward()[0][1])], "item_id long, text string")
    for most in (10**6, 0):
        assert rows(decontaminate.contamination(clashing, bench, broadcast_words=most)) == rows(decontaminate.contamination(plain, bench, broadcast_words=most))


def test_long_and_repeated_texts_by_hand(plain):
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in awkward() if len(t or "") < 2000]
    want = sorted(bytes(np.frombuffer(b, np.uint8)[~g]) for (_, b), g in zip(data, brute(data), strict=True))
    got = suffix.remove_repeats(plain).collect()
    assert sorted(bytes(r["kept"]) for r in got if r["n_bytes"] < 2000) == want
    huge = {r["doc_id"]: r for r in got if r["n_bytes"] > 2000}
    # what lies in the shorter copy alone goes, all but a tail shorter than a string that ends with it
    assert len(huge[8]["kept"]) > 300_000 and len(huge[9]["kept"]) == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_all_columns(spark, plain, clashing, tmp_path, name):
    spark.createDataFrame([(1, awkward()[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    apply = dict(corpus_pipeline.STAGES)[name]
    got = apply(spark, clashing, str(tmp_path))
    if name != "bpe_coding":
        assert got.columns == clashing.columns
    assert set(clashing.columns) <= set(got.columns)
    assert rows(got.select("doc_id", "text")) == rows(apply(spark, plain, str(tmp_path)).select("doc_id", "text"))
    assert apply(spark, clashing.limit(0), str(tmp_path)).count() == 0
