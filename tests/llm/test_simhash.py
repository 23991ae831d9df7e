import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import simhash
from millrace.llm.components import connected_components
from millrace.llm.queries import op4_simhash_neardup
from tests.llm.fixtures import documents, empty, texts


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_query(spark, tmp_path):
    values = [t for t in texts() if len(t or "") < 50_000]
    values += [values[0] + f" tail{k}" for k in range(30)]
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op4_simhash_neardup(spark, str(tmp_path)).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(values)}
    want = brute_components(list(fps), fps)
    assert len(rows) == len(values)
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:
        for _ in range(8):
            for _ in range(r.randrange(1, 5)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values |= {7, 7 ^ 3, 7 ^ 12, 2**63, 2**63 + 1, 0}
    values = sorted(values)
    nodes = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)], "node long, fp binary")
    found = dict(connected_components(simhash.links(nodes, 64, 2, 2)).collect())
    want = brute_components(range(len(values)), values)
    assert {i: found.get(i, i) for i in range(len(values))} == want
    assert len(set(want.values())) > 200


def test_bands_link_what_any_band_brings_together():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, (40, 2), dtype=np.uint64)
    rows = np.repeat(base, 12, axis=0)
    for row in rows:
        for _ in range(r.integers(0, 9)):
            row[r.integers(2)] ^= np.uint64(1 << int(r.integers(64)))
    rows = np.unique(rows, axis=0)
    n, bits, budget, limit = len(rows), 32, 2, 9
    codes = [(rows[:, w] >> np.uint64(s)) & np.uint64(2**32 - 1) for w in (0, 1) for s in (32, 0)]
    dist = np.bitwise_count(rows[:, None, :] ^ rows[None, :, :]).sum(axis=2)
    for code in codes:
        near = (np.bitwise_count(code[:, None] ^ code[None, :]) <= budget) & (dist <= limit)
        want = np.arange(n)
        for _ in range(n):
            new = np.array([want[near[i]].min() for i in range(n)])
            if np.array_equal(new, want):
                break
            want = new
        a, b = _one_subtree(code, rows, bits, budget, limit)
        label = simhash._joined(np.arange(n), np.asarray(a), np.asarray(b))
        assert np.array_equal(label, want)


def _one_subtree(code, rows, bits, budget, limit):
    """linked() over the union of its rotations, as the tasks do it."""
    a, b = [], []
    widths = simhash._widths(bits, budget)
    for k, width in enumerate(widths):
        by = np.uint64(k * widths[0])
        turned = ((code << by) | (code >> (np.uint64(bits) - by))) & np.uint64(2**bits - 1) if k else code
        key = (turned >> np.uint64(bits - width)).astype(np.int64)
        x, y = simhash.linked(key, np.full(len(code), -1), turned, np.zeros(len(code), np.int64), rows, bits, budget, limit)
        a += x.tolist()
        b += y.tolist()
    return a, b


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {300: 300, 301: 300}


def test_keep_one(spark):
    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    near = [" ".join("changed" if k in (40, 200) else w for k, w in enumerate(t.split())) for t in base]
    values = base + base + near + [None, "", None]
    docs = documents(spark, values)
    docs = docs.union(docs.filter("doc_id = 3"))
    kept = simhash.keep_one(docs, shingle=5, words=8, bits=32, budget=3, max_bits=90)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [*range(20), 60]
    nulls = spark.createDataFrame([(None, "only one here"), (None, "quite another text"), (5, "only one here")], "doc_id long, text string")
    assert sorted((x["doc_id"] or -1, x["text"]) for x in simhash.keep_one(nulls).collect()) == [(-1, "quite another text"), (5, "only one here")]


def shingle_set(text, size=5):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def prose(r, n):
    return [f"w{r.randrange(50_000)}" for _ in range(n)]


def test_a_repeated_shingle_does_not_make_copies(spark):
    r = random.Random(6)
    values = [" ".join([*prose(r, 500), *["rule"] * 70, *prose(r, 430)]) for _ in range(8)]
    assert max(jaccard(a, b) for a in values for b in values if a is not b) < 0.01
    assert simhash.keep_one(documents(spark, values), **corpus_pipeline.NEAR).count() == len(values)


def altered(r, n, share):
    """A text and one that differs in words of its end, at about that similarity."""
    words = prose(r, n)
    k = round(n * (1 - share) / (1 + share))
    return " ".join(words), " ".join(words[: n - k] + prose(r, k))


@pytest.mark.parametrize("block", [None, 50])
def test_links_are_of_the_exact_similarity(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(8)
    pairs = [altered(r, 300, 0.7 + 0.001 * k) for k in range(95)] + [altered(r, 300, 0.9) for _ in range(20)]
    values = [t for p in pairs for t in p]
    rows = {x["doc_id"]: x["group"] for x in simhash.near_duplicates(documents(spark, values), **corpus_pipeline.NEAR).collect()}
    linked = [rows[2 * k] == rows[2 * k + 1] for k in range(len(pairs))]
    like = [jaccard(*p) for p in pairs]
    assert not [c for c, hit in zip(like, linked, strict=True) if hit and c < 0.8]
    assert all(hit for c, hit in zip(like, linked, strict=True) if c >= 0.88)
    assert len(set(rows.values())) == len(values) - sum(linked)


@pytest.mark.parametrize("n", [64, 204, 1004])
def test_pairs_just_above_the_similarity_are_found(spark, n):
    r = random.Random(n)
    k = (n - 4) // 9  # of so many shingles the last k are replaced: (1 - 1/9) / (1 + 1/9) is 0.8
    pairs = []
    for _ in range(150):
        words = prose(r, n)
        pairs.append((" ".join(words), " ".join(words[: n - k] + prose(r, k))))
    assert all(0.8 <= jaccard(*p) < 0.83 for p in pairs)
    kept = simhash.keep_one(documents(spark, [t for p in pairs for t in p]), **corpus_pipeline.NEAR).count()
    assert len(pairs) <= kept <= 1.03 * len(pairs)


def test_alike_equals_all_pairs():
    r = np.random.default_rng(3)
    sets = [np.zeros(0, np.uint64), np.array([5], np.uint64)]
    for _ in range(12):
        base = r.integers(0, 2**63, int(r.integers(5, 60)), dtype=np.uint64)
        for _ in range(8):
            keep = base[r.random(len(base)) < r.choice([0.85, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(0, 6)), dtype=np.uint64), [np.uint64(1)]])))
    n = len(sets)
    near = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for b in sets] for a in sets])
    want = np.arange(n)
    for _ in range(n):
        want = np.array([want[near[i]].min() for i in range(n)])
    assert np.array_equal(simhash.alike(sets, 0.8), want)
    assert 20 < len(set(want.tolist())) < n


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).collect() == []


def brute_groups(values, similarity):
    sets = [shingle_set(t) for t in values]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("sets", [10**6, 7, 2])
def test_groups_of_many_blocks_equal_all_pairs(spark, monkeypatch, sets):
    """A template in many versions: most link, some by chains alone, and some are candidates that do not."""
    monkeypatch.setattr(simhash, "BLOCK_SETS", sets)
    r = random.Random(14)
    words = prose(r, 300)

    def version(cut):
        at = r.randrange(300 - cut) if cut else 0
        return " ".join(words[:at] + prose(r, cut) + words[at + cut :])

    values = [version(r.choice([0, 5, 10, 30, 45, 60])) for _ in range(60)]
    rows = {x["doc_id"]: x["group"] for x in simhash.near_duplicates(documents(spark, values), shingle=5, words=8, bits=32, budget=3, max_bits=200, similarity=0.8).collect()}
    want = brute_groups(values, 0.8)
    assert 5 < len(set(want)) < 50
    same = lambda g: [[g[i] == g[j] for j in range(i)] for i in range(len(values))]
    assert same(rows) == same(want)


def test_frequent_keys_are_joined_where_they_lie(spark, monkeypatch):
    from millrace.llm import common

    left = common.stage(spark.createDataFrame([(k % 5 if k % 7 else None, k) for k in range(200)], "k int, v int"), "left")
    right = spark.createDataFrame([(k, k * 10) for k in range(4)], "k int, w int")
    for how in ("inner", "left"):
        want = sorted(map(repr, left.join(right, "k", how).select("k", "v", "w").collect()))
        for rows, keys in ((100_000, 10), (20, 10), (20, 0), (0, 10)):
            monkeypatch.setattr(common, "HOT_ROWS", rows)
            monkeypatch.setattr(common, "HOT_KEYS", keys)
            monkeypatch.setattr(common.frequent, "__defaults__", (rows,))
            assert sorted(map(repr, common.join_one(left, right, "k", how).select("k", "v", "w").collect())) == want
