import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm.common import stage
from millrace.llm.queries import tokenizer
from tests.llm import test_decontaminate, test_quality, test_suffix
from tests.llm.fixtures import documents, empty, texts

DATA = "/root/testdata/sf0.001"


def prose(r, n):
    return " ".join("".join(r.choice(["ra", "te", "lo", "mi", "sun", "ket", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def planted():
    """Texts, and the ids that each stage takes away."""
    r = random.Random(11)
    clean = [prose(r, r.randrange(80, 400)) for _ in range(60)]
    passage, items = prose(r, 60), [prose(r, 25), prose(r, 6)]
    values = list(clean)
    gone = {"quality_rules": [], "simhash_near_dedup": [], "benchmark_decontamination": []}

    def add(text, by=None):
        values.append(text)
        if by:
            gone[by].append(len(values) - 1)

    for junk in (None, "", "  \n ", "too short", "same words " * 90, " ".join(w + "%%%" for w in prose(r, 200).split()), " | ".join(prose(r, 200).split())):
        add(junk, "quality_rules")
    for k in range(12):
        add(clean[k], "simhash_near_dedup")
        words = clean[k].split()
        words[len(words) // 2] = "altered"
        if len(shingles(clean[k]) & shingles(" ".join(words))) >= 0.9 * len(shingles(clean[k]) | shingles(" ".join(words))):
            add(" ".join(words), "simhash_near_dedup")
    bearers = []
    for _ in range(4):
        add(prose(r, 150) + " " + passage + " " + prose(r, 150))
        bearers.append(len(values) - 1)
    for item in items:
        add(prose(r, 100) + " " + "".join(c.upper() if c.isascii() else c for c in item) + ". " + prose(r, 100), "benchmark_decontamination")
    return values, gone, bearers, passage, items


def test_stages_take_what_is_planted_and_leave_the_rest(spark, tmp_path):
    values, gone, bearers, passage, items = planted()
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, set(range(len(values)))
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, str(tmp_path)), name)
        left -= set(gone.get(name, []))
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert set(rows) == left, name
        assert docs.columns == (columns if name != "bpe_coding" else [*(c for c in columns if c != "token_ids"), "token_ids", "n_tokens", "round_trip"])
        for i, r in rows.items():
            want = values[i]
            if name not in ("quality_rules", "simhash_near_dedup") and i in bearers[1:]:
                assert passage not in r["text"] and len(r["text"]) <= len(want) - len(passage) and r["n_chars"] == len(r["text"])
            else:
                assert r["text"] == want and r["n_chars"] == len(want)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows.values())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["token_ids"] for r in again.collect()} == {i: r["token_ids"] for i, r in rows.items()}


def test_every_stage_takes_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    awkward = documents(spark, texts())
    awkward = awkward.union(awkward.limit(3))
    nulls = spark.createDataFrame([(None,) * 5, (None, "a b c", None, None, None), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, apply in corpus_pipeline.STAGES:
        for docs in (awkward, nulls, empty(spark)):
            got = apply(spark, docs, str(tmp_path))
            if name != "bpe_coding":
                assert got.columns == docs.columns, name
            n = got.count()
            assert n <= docs.count() and (n > 0 or docs is not awkward)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_stages_equal_brute_force_on_the_smallest_tables(spark):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, DATA), name)
        now = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            for i, text in before.items():
                n, _, symbols, _, repeats = test_quality.brute(text)
                bad = n < 50 or 100 * repeats > 50 * n or symbols > 0.1 * n
                assert (i not in now) >= bad
        elif name == "simhash_near_dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            ids = sorted(before)
            assert not [(a, b) for a in now for b in now if a < b and like(a, b) >= 0.85]
            assert all(any(like(i, k) >= 0.65 for k in ids if k != i) for i in set(before) - set(now))
        elif name == "suffix_array_dedup":
            rows = [(i, t.encode()) for i, t in sorted(before.items())]
            for (i, data), gone in zip(rows, test_suffix.brute(rows, corpus_pipeline.PASSAGE_BYTES), strict=True):
                left = bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
                assert (now[i]["text"] == left) if i in now else not left.strip()
        elif name == "benchmark_decontamination":
            hit = test_decontaminate.brute(list(before.values()), items)
            assert set(now) == {i for k, i in enumerate(before) if not hit[k][2]}
        else:
            assert all(r["round_trip"] and r["token_ids"] == library.encode(r["text"], add_special_tokens=False).ids for r in now.values())
        before = {i: r["text"] for i, r in now.items()}
