import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.queries import op8_shards
from tests.llm.fixtures import documents, empty, texts


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 90))
def test_best_fit_equals_a_plain_search(sizes, capacity):
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if not fits:
            rooms.append(capacity)
            fits = [(capacity, len(rooms) - 1)]
        b = min(fits)[1]
        rooms[b] -= sizes[i]
        want[i] = b
    assert sharding.best_fit_decreasing(sizes, capacity) == want


def test_fixed_bins_come_out_near_equal():
    sizes = [7] * 100 + [3] * 50 + [1] * 33
    where = sharding.best_fit_decreasing(sizes, -(-sum(sizes) // 4), 4)
    load = Counter()
    for s, b in zip(sizes, where, strict=True):
        load[b] += s
    assert max(load.values()) - min(load.values()) <= 7


def test_query(spark, tmp_path):
    values = texts(n=400)
    values = [t for t in values if len(t or "") < 5000] + ["hot passage of text"] * 900
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_shards(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(values)))
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = values[r["doc_id"]]
        data = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[t].add(r["shard"])
    assert set(load) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.1 * sum(load.values()) / 16
    assert all(len(s) == 1 for t, s in groups.items() if t != "hot passage of text")


def test_capacity_opens_as_many_shards_as_needed(spark):
    rows = sharding.pack(documents(spark), shards=None, capacity=20_000).collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert all(v <= 20_000 or v > 60_000 for v in load.values())


def test_empty_table_and_files(spark, tmp_path):
    assert sharding.pack(empty(spark)).collect() == []
    docs = documents(spark).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(1, "again"), (1, "again"), (1, None), (None, "null id"), (None, "null id")], docs.schema)).withColumn("row", F.lit("clash"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted((repr(r["doc_id"]), repr(r["text"])) for r in df.collect())
    assert key(back) == key(docs) and sorted(back.columns) == ["doc_id", "row", "shard", "slot", "text"]


def test_loads_equal_best_fit_of_all_groups(spark):
    """With a unit of one byte every group is an item, so the query is plain best fit."""
    values = [t for t in texts(n=150) if t and len(t) < 3000]
    loads = Counter()
    for r in sharding.pack(documents(spark, values), shards=5, resolution=10**9).collect():
        loads[r["shard"]] += r["size"]
    groups = Counter()
    for t in values:
        groups[t] += len(t.encode()) + 1
    total = sum(groups.values())
    room = -(-total // 5)
    assert max(groups.values()) <= room
    want, sizes = Counter(), list(groups.values())
    for size, b in zip(sizes, sharding.best_fit_decreasing(sizes, room, 5), strict=True):
        want[b] += size
    assert sorted(loads.values()) == sorted(want.values())


@pytest.mark.parametrize("parcel", [1, 64])
def test_capacity_needs_few_shards(spark, monkeypatch, parcel):
    monkeypatch.setattr(sharding, "PARCEL", parcel)
    values = [t for t in texts(n=600) if len(t or "") < 5000]
    loads, slots = Counter(), defaultdict(list)
    for r in sharding.pack(documents(spark, values), shards=None, capacity=9000).collect():
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    least = -(-sum(loads.values()) // 9000)
    assert max(loads.values()) <= 9000 and sorted(loads) == list(range(len(loads)))
    assert len(loads) <= least * (1.03 if parcel == 64 else 1.7) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
