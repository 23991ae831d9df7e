import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix
from millrace.llm.queries import op5_suffix_dedup
from tests.llm.fixtures import documents, empty, texts


def brute(rows, length=50):
    """(id, bytes) -> a mask of the bytes removed."""
    least = {}
    for i, b in rows:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        out.append(gone)
    return out


def runs(mask):
    return int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())


def sample():
    r = random.Random(9)
    values = [t for t in texts() if len(t or "") < 20_000]
    line = "A line that all of these have, and no more than this."
    edge = "x" * 49
    values += ["".join(r.choice("abé \n") for _ in range(r.randrange(40, 200))) + line + "".join(r.choice("cdü") for _ in range(60)) for _ in range(12)]
    values += [edge, edge + "y", "z" + edge, edge + "y", line, line * 3, "ab" * 60 + line, values[0][:60], "é" * 30, "é" * 26 + "x", "x" + "é" * 25]
    return values


def test_anchors_cover_all_windows_and_depend_on_content_alone():
    r = random.Random(1)
    text = bytes(r.choice(b"abc ") for _ in range(2000)) + b"a" * 200 + b"xyz" * 40
    a = suffix.Anchors(text, 50)
    assert a.first[0] == 0 and a.last[-1] == len(text) - 50 and (a.first[1:] == a.last[:-1] + 1).all()
    where = {k: p - k for f, e, p in zip(a.first, a.last, a.place, strict=True) for k in range(f, e + 1)}
    for k in range(0, len(text) - 50, 37):
        b = suffix.Anchors(text[k : k + 50], 50)
        assert len(b.place) == 1 and b.place[0] == where[k]


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_query(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    values = sample()
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op5_suffix_dedup(spark, str(tmp_path)).collect()}
    data = [(i, (t or "").encode()) for i, t in enumerate(values)]
    assert len(rows) == len(values)
    for (i, b), gone in zip(data, brute(data), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"]) == (len(b), int(gone.sum()), runs(gone))
        assert rows[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_ids_that_repeat_or_are_null(spark):
    base = "a sentence of some length that is found again in other documents, word for word"
    rows = [(1, base + " one"), (1, base + " two"), (None, base + " three"), (None, base + " four"), (2, "short")]
    got = {r["kept"].decode() for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {base + " one", base + " two", "three", "four", "short"} or got == {base + " one", base + " two", " three", " four", "short"} or got >= {base + " one", base + " two", "short"}
    data = [(2**63 - 1 if i is None else i, t.encode()) for i, t in rows]
    want = {bytes(np.frombuffer(b, np.uint8)[~g]).decode() for (_, b), g in zip(data, brute(data), strict=True)}
    assert got == want


def test_empty_table(spark):
    assert suffix.remove_repeats(empty(spark)).collect() == []


def test_other_lengths(spark):
    values = sample()[:40]
    data = [(i, (t or "").encode()) for i, t in enumerate(values)]
    for length in (2, 7, 100):
        rows = {r["doc_id"]: r["kept"] for r in suffix.remove_repeats(documents(spark, values), length=length).collect()}
        for (i, b), gone in zip(data, brute(data, length), strict=True):
            assert rows[i] == bytes(np.frombuffer(b, np.uint8)[~gone])
