import os
import re

import pytest

from millrace.llm import quality
from millrace.llm.queries import op6_quality_rules
from tests.llm.fixtures import documents, empty, texts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_brute_force(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    values = texts()
    rows = op6_quality_rules(spark, str(tmp_path)).collect()
    assert len(rows) == len(values)
    for r in rows:
        want = brute(values[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_maximisation_finds_accuracies():
    import random

    r = random.Random(1)
    chances = [((0.02, 0.1, 0.88), (0.7, 0.1, 0.2)), ((0.05, 0.15, 0.8), (0.5, 0.2, 0.3)), ((0.01, 0.5, 0.49), (0.3, 0.5, 0.2))]
    patterns = {}
    for _ in range(20_000):
        y = r.random() >= 0.8
        v = tuple(r.choices((-1, 0, 1), c[y])[0] for c in chances)
        patterns[v] = patterns.get(v, 0) + 1
    model = quality.expectation_maximisation(patterns, 3)
    assert abs(model.prior - 0.8) < 0.06
    for found, true in zip(model.votes, chances, strict=True):
        assert all(abs(a - b) < 0.1 for f, t in zip(found, true, strict=True) for a, b in zip(f, t, strict=True))
    odds = quality.expectation_maximisation({}, 3)
    assert odds.prior == 0.9


def test_keep_good_agrees_with_assess_and_keeps_columns(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.assess(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_empty_table_and_clear_junk(spark):
    assert quality.assess(empty(spark)).collect() == []
    assert quality.keep_good(empty(spark)).collect() == []
    good = [" ".join(f"word{i}{j}" for j in range(80)) for i in range(30)]
    junk = [" ".join(f"w{i}{j}%%%" for j in range(80)) for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(documents(spark, good + junk)).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[i] for i in range(30, 35))


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_verdicts_agree_with_the_labels(spark):
    """Of labelled documents that pass the base nearly all good ones are kept and nearly all bad ones go."""
    found = quality.assess(spark.read.parquet(f"{DATA}/documents.parquet")).filter("NOT base_failed")
    seen = found.join(spark.read.parquet(f"{DATA}/labels.parquet").dropna(subset=["quality"]), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in seen}
    assert n[1, True] > 1000 and n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] > 100 and n.get((0, True), 0) <= 0.01 * n[0, False]
