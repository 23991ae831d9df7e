import hashlib
import re

import pytest

from millrace.llm import decontaminate
from millrace.llm.queries import op7_decontaminate
from tests.llm.fixtures import documents, empty, texts


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def items_for(values):
    long = [words(t) for t in values if t and len(words(t)) > 40]
    made = [" ".join(long[0][5:30]), " ".join(w.upper() for w in long[1][10:21]), "one TWO", "a a a a", "", None, "!!", " ".join(long[2][:9]), "never found at all " * 4, "echo " * 30, " ".join(long[0][8:25]) + " other words"]
    return [(k * 7 % 13, t) for k, t in enumerate(made)] + [(0, made[0])]


def brute(values, items):
    out = {}
    for i, t in enumerate(values):
        ws, hit, found = words(t), set(), set()
        place = {}
        for k in range(len(ws)):
            place.setdefault(ws[k], []).append(k)
        for name, text in items:
            iw = words(text)
            for k in range(max(1, len(iw) - 9) if iw else 0):
                w = iw[k : k + 10]
                for p in place.get(w[0], []):
                    if ws[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        found.add(str(name))
        out[i] = (len(ws), len(hit), sorted(found))
    return out


@pytest.mark.parametrize(("most", "hot"), [(decontaminate.BROADCAST_WORDS, 0), (20, decontaminate.HOT_ROWS), (20, 3)])
def test_equals_brute_force(spark, monkeypatch, most, hot):
    monkeypatch.setattr(decontaminate, "HOT_ROWS", hot)
    monkeypatch.setattr(decontaminate, "PLACES", 7 if hot == 3 else decontaminate.PLACES)
    values = texts()
    items = items_for(values)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark), bench, broadcast_words=most).collect()
    want = brute(values, items)
    assert len(got) == len(values)
    for r in got:
        assert (r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)), r["items"]) == want[r["doc_id"]]


def test_query(spark, tmp_path):
    values = texts()
    items = items_for(values)
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(values, items)
    for r in op7_decontaminate(spark, str(tmp_path)).collect():
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


@pytest.mark.parametrize("most", [100, 0])
def test_nulls_repeats_and_carried_columns(spark, most):
    line = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "x " + line + " y", 5), (1, "x " + line + " y", 6), (None, line, 7), (2, None, 8), (3, "five six", 9)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(None, line), (7, line), (7, line), (8, "five SIX"), (None, None)], "item_id long, text string")
    got = decontaminate.contamination(docs, bench, broadcast_words=most, carry=True).collect()
    assert sorted((r["row"]["items"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)), tuple(r["items"])) for r in got) == [(5, 13, 11, ("7", "8")), (6, 13, 11, ("7", "8")), (7, 11, 11, ("7", "8")), (8, 0, 0, ()), (9, 2, 2, ("8",))]
    alone = decontaminate.contamination(docs, bench.filter("item_id IS NULL"), broadcast_words=most).collect()
    assert sum(bool(r["starts"]) for r in alone) == 3 and not any(r["items"] for r in alone)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(empty(spark), bench).collect() == []
    got = decontaminate.contamination(documents(spark), bench.limit(0)).collect()
    assert len(got) == len(texts()) and not any(r["items"] for r in got)
