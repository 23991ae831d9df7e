"""SimHash near-duplicates by a binary trie self-join.

A fingerprint sets each bit that more than half of a text's shingle hashes set. Equal fingerprints
collapse first. The others meet in binary tries: pairs of nodes are walked down together from a
common root, their differing bits add up, and a pair beyond the error budget is left, with all that
is below it. For the walk to be shared out, a code of b bits with budget e enters e + 1 tries, each
rotated so that another of e + 1 blocks of bits leads: of codes that differ in e bits or fewer, one
block is equal. Codes with the same leading block form a subtree, and subtrees are what tasks get.
A subtree of more than HOT codes is dealt out further, as the pairs of its children SPLIT bits down
that are within the budget.

What is linked in a task leaves it as a spanning star, never as all pairs.

Where a similarity is asked for, fingerprints count each distinct shingle once and only propose: within
each group that they link, the sets of shingles are compared exactly, and only pairs whose Jaccard
similarity reaches it link. A group of many shingles is dealt out in blocks. What the blocks by themselves
and one pivot set that goes to each of them do not bring together with most of the group, and that alone,
meets all of it in a second round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import column, id_and_text, join_one, ranges, stage, texts_of, whole_groups
from millrace.llm.components import connected_components

HOT, SPLIT = 200_000, 8
#: Shingles, and sets of them, in a block of a group whose sets are compared.
BLOCK, BLOCK_SETS = 2_000_000, 4_000
#: Node pairs handled at a time; pairs of subtrees with so few pairs of codes are compared at once.
FRONTIER, SMALL = 200_000, 32
#: Links that a task holds to send each once.
LINKS = 400_000
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of lower-cased words, repeats included; fewer words than
    size form one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([_hash(joined)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter(map(_hash, [joined[a : b - 1] for a, b in zip(starts, starts[size:], strict=False)]), np.uint64, len(words) - size + 1)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash made of a hash; the 0-th is itself."""
    if not k:
        return x
    x = x + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 * words bits, the highest first; zero for no hashes."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255 * 32):  # 255 rows of bits add up in a byte
        part = hashes[at : at + 255 * 32]
        bits = np.unpackbits(np.stack([_mixed(part, k) for k in range(words)], axis=1).astype(">u8").view(np.uint8), axis=1)
        full = len(part) // 255 * 255
        total += np.add.reduce(bits[:full].reshape(-1, 255, 64 * words), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (binary, 8 * words bytes) of every whole text; with
    distinct each shingle of a text counts once, and set_key (a hash of the set) and n_set (its size) follow.

    A null, empty or blank text has no shingles and the fingerprint zero."""
    slim = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.BinaryType())])
    if distinct:
        schema = schema.add("set_key", "long").add("n_set", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, n = [], [], []
            for t in texts_of(batch):
                hashes = shingle_hashes(t, shingle)
                if distinct:
                    hashes = np.unique(hashes)
                    key.append(_hash(hashes.tobytes()))
                    n.append(len(hashes))
                fp.append(fingerprint(hashes, words))
            more = [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(n, pa.int64())] if distinct else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fp, pa.binary()), *more], schema.names)

    return slim.mapInArrow(run, schema)


def _products(alo: np.ndarray, na: np.ndarray, blo: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each range with its partner, FRONTIER or so at a time."""
    rows_lo, rows_n = np.repeat(blo, na), np.repeat(nb, na)
    rows = ranges(alo, na)
    ends = np.cumsum(rows_n)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, "right")))
        yield np.repeat(rows[at:upto], rows_n[at:upto]), ranges(rows_lo[at:upto], rows_n[at:upto])
        at = upto


def trie_join(codes: np.ndarray, roots: tuple[np.ndarray, ...], bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of codes that differ in budget bits or fewer.

    bits: how many of the lowest to walk; above, the codes of a subtree agree. codes: sorted within each subtree, none twice. roots: (a from, a to, b from, b to), the node
    pairs to begin with, as ranges of codes; equal ranges join with themselves."""
    stack = [(bits - 1, *roots)]
    bit_at, ones = -1, np.zeros(0, np.int64)
    while stack:
        bit, alo, ahi, blo, bhi = stack.pop()
        same = alo == blo
        size = (ahi - alo) * (bhi - blo)
        now = (size <= SMALL) | (bit < 0)
        for i, j in _products(alo[now], (ahi - alo)[now], blo[now], (bhi - blo)[now]):
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            yield i[near], j[near]
        alo, ahi, blo, bhi, same = alo[~now], ahi[~now], blo[~now], bhi[~now], same[~now]
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, alo[:half], ahi[:half], blo[:half], bhi[:half]), (bit, alo[half:], ahi[half:], blo[half:], bhi[half:])]
            continue
        if bit_at != bit:
            bit_at, ones = bit, np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        apart = ~same
        a0, a1 = np.concatenate([alo, amid, alo, amid[apart]]), np.concatenate([amid, ahi, amid, ahi[apart]])
        b0, b1 = np.concatenate([blo, bmid, bmid, blo[apart]]), np.concatenate([bmid, bhi, bhi, bmid[apart]])
        some = (a1 > a0) & (b1 > b0)
        a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
        high = np.uint64(2**64 - 2**bit)  # the bits walked so far hold the errors so far
        within = np.bitwise_count((codes[a0] ^ codes[b0]) & high) <= budget
        stack.append((bit - 1, a0[within], a1[within], b0[within], b1[within]))


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the smallest index of its class) after linking a with b."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def linked(keys: np.ndarray, split: np.ndarray, codes: np.ndarray, child: np.ndarray, fps: np.ndarray, bits: int, budget: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and for each the first row of its class, where that is another.

    keys: the subtree of each row. split: -1, or u << SPLIT | v for the pair of children that it
    stands for. fps: the full fingerprints (rows, words); rows whose codes are within the budget link
    if their fingerprints differ in max_bits or fewer. Rows of one code are compared with the first
    of them, and further only as far as that leaves them apart."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((codes, split, keys))
    keys, split, codes, child, fps = keys[order], split[order], codes[order], child[order], fps[order]
    group = np.concatenate([[True], (keys[1:] != keys[:-1]) | (split[1:] != split[:-1])])
    leaf = group | np.concatenate([[True], codes[1:] != codes[:-1]])
    first = np.nonzero(leaf)[0]
    members = np.diff(np.append(first, n))
    leaf_code = codes[first]
    glo = np.nonzero(group[first])[0]
    ghi = np.append(glo[1:], len(first))
    pair = split[first[glo]]
    u, v = pair >> SPLIT, pair & (2**SPLIT - 1)
    crossed = (pair >= 0) & (u != v)
    ones = np.concatenate([[0], np.cumsum(child[first] == np.repeat(u, ghi - glo))])
    middle = np.where(crossed, glo + ones[ghi] - ones[glo], ghi)  # a crossed group holds u's codes, then v's
    roots = (glo, middle, np.where(crossed, middle, glo), ghi)
    some = (roots[1] > roots[0]) & (roots[3] > roots[2])
    roots = tuple(r[some] for r in roots)

    near = lambda i, j: np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= max_bits
    labels = np.arange(n)
    rest = np.nonzero(~leaf)[0]
    head = np.repeat(first, members)[rest]
    close = near(head, rest)
    labels = _joined(labels, head[close], rest[close])
    where = np.repeat(np.arange(len(first)), members)
    far = rest[~close]
    for i, j in _products(far, np.ones(len(far), np.int64), first[where[far]], members[where[far]]):
        apart = (labels[i] != labels[j]) & (i != j)
        i, j = i[apart], j[apart]
        hit = near(i, j)
        labels = _joined(labels, i[hit], j[hit])
    for i, j in trie_join(leaf_code, roots, bits - _widths(bits, budget)[-1], budget):
        a, b = first[i], first[j]
        hit = near(a, b)
        labels = _joined(labels, a[hit], b[hit])
        more = members[i] * members[j] > 1
        i, j = i[more], j[more]
        uneven = np.logical_or.reduceat(labels != labels[np.repeat(first, members)], first)
        open_ = uneven[i] | uneven[j] | (labels[first[i]] != labels[first[j]])
        i, j = i[open_], j[open_]
        for a, b in _products(first[i], members[i], first[j], members[j]):
            apart = labels[a] != labels[b]
            a, b = a[apart], b[apart]
            hit = near(a, b)
            labels = _joined(labels, a[hit], b[hit])
    other = np.nonzero(labels != np.arange(n))[0]
    return order[other], order[labels[other]]


def _widths(bits: int, budget: int) -> list[int]:
    """Bits of the blocks that lead in each rotation; all but the last are as long as the first."""
    lead = math.ceil(bits / (budget + 1))
    return [min(lead, bits - k * lead) for k in range(budget + 1)]


def _tries(nodes: DataFrame, bits: int, budget: int, words: int, hot: np.ndarray | None) -> DataFrame:
    """key, split, code, child, node, fp: each fingerprint once for each band and rotation, in hot
    subtrees once for each pair of children that it can take part in. Without hot, key alone."""
    widths = _widths(bits, budget)
    near = np.array([sum(1 << b for b in c) for k in range(min(budget, SPLIT) + 1) for c in combinations(range(SPLIT), k)], np.int64)
    schema = "key long" if hot is None else "key long, split int, code long, child int, node long, fp binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(2**bits - 1)
        for batch in batches:
            full = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
            for band in range(64 * words // bits):
                word, shift = divmod(band * bits, 64)
                code = (full[:, word] >> np.uint64(64 - bits - shift)) & mask
                for rotation, width in enumerate(widths):
                    by = np.uint64(rotation * widths[0])
                    turned = ((code << by) | (code >> (np.uint64(bits) - by))) & mask if rotation else code
                    key = np.int64(band * len(widths) + rotation) << np.int64(40) | (turned >> np.uint64(bits - width)).astype(np.int64)
                    if hot is None:
                        yield pa.RecordBatch.from_arrays([pa.array(key)], names)
                        continue
                    child = (turned >> np.uint64(bits - width - SPLIT)).astype(np.int64) & (2**SPLIT - 1)
                    much = np.isin(key, hot)
                    row = np.concatenate([np.nonzero(~much)[0], np.repeat(np.nonzero(much)[0], len(near))])
                    split = np.full(len(row), -1, np.int64)
                    cold = len(key) - int(much.sum())
                    mate = child[row[cold:]] ^ np.tile(near, int(much.sum()))
                    split[cold:] = np.minimum(child[row[cold:]], mate) << SPLIT | np.maximum(child[row[cold:]], mate)
                    take = pa.array(row)
                    made = [pa.array(key[row]), pa.array(split.astype(np.int32)), pa.array(turned.view(np.int64)[row]), pa.array(child[row].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*made, batch.column("node").take(take), batch.column("fp").take(take)], names)

    return nodes.select("node", "fp").mapInArrow(run, schema)


def _starred(member: np.ndarray, root: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes, given as rows and the first row of each one's class, as links of each node with the smallest
    of the class: so the classes that many tasks find of one group hang on one node, by the same links."""
    heads, at = np.unique(root, return_inverse=True)
    least = node[heads]
    np.minimum.at(least, at, node[member])
    a, b = np.concatenate([node[member], node[heads]]), np.concatenate([least[at], least])
    return a[a != b], b[a != b]


def _once(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """a, b: the links of a task, each once as far as LINKS of them are held at a time."""
    held: list[np.ndarray] = []
    for a, b in links:
        held.append(np.stack([a, b], axis=1))
        if sum(map(len, held)) > LINKS:
            held = [np.unique(np.concatenate(held), axis=0)]
            if len(held[0]) > LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[0][:, k])) for k in (0, 1)], ["a", "b"])
                held = []
    if held:
        found = np.unique(np.concatenate(held), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])
    pa.default_memory_pool().release_unused()


def links(nodes: DataFrame, bits: int, budget: int, max_bits: int, words: int = 1) -> DataFrame:
    """a, b: nodes (node long, fp binary, each fingerprint once) that link, as spanning stars.

    A subtree is hot from HOT rows on. There are no more subtrees than leading blocks of bits, so the list
    of hot ones that goes to the executors is bounded by the fingerprint, whatever the number of rows."""
    busy = _tries(nodes, bits, budget, words, None).groupBy("key").count().filter(F.col("count") > HOT).collect()
    hot = np.array(sorted(r["key"] for r in busy), np.int64)
    dealt = _tries(nodes, bits, budget, words, hot).repartition("key", "split").sortWithinPartitions("key", "split")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table in whole_groups(batches, ["key", "split"], 100_000):
            keys, split, code, child, node = (table.column(c).to_numpy() for c in ("key", "split", "code", "child", "node"))
            full = np.frombuffer(b"".join(table.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
            a, b = linked(keys, split.astype(np.int64), code.view(np.uint64), child, full, bits, budget, max_bits)
            yield _starred(a, b, node)

    return dealt.mapInArrow(lambda batches: _once(found(batches)), "a long, b long")


def alike(sets: list[np.ndarray], similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """For each set (sorted hashes) the first one of its class: sets link if their Jaccard similarity
    is similarity or more, or if they are of one class of known.

    Two such sets of sizes n and m share at least similarity * max(n, m) hashes, and so one of the
    n - ceil(similarity * n) + 1 smallest of the one with those of the other: only sets that share one
    there are compared, and only while they are apart."""
    labels = list(range(len(sets)))
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        labels = first[of].tolist()
    tested = bytearray(len(sets) * len(sets) // 8 + 1)  # a bit for each pair

    def find(i: int) -> int:
        while labels[i] != i:
            labels[i] = i = labels[labels[i]]
        return i

    def compare(i: int, j: int) -> None:
        x, y = find(i), find(j)
        i, j = min(i, j), max(i, j)
        bit = i * len(sets) + j
        if x == y or tested[bit >> 3] >> (bit & 7) & 1:
            return
        tested[bit >> 3] |= 1 << (bit & 7)
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        if len(a) < similarity * len(b) - 1e-6:
            return
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        if both >= similarity * (len(a) + len(b) - both) - 1e-6:
            labels[max(x, y)] = min(x, y)

    heads = [a[: len(a) - math.ceil(similarity * len(a) - 1e-6) + 1] for a in sets]
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    if not len(owner):
        return np.array(labels, np.int64)
    value = np.concatenate(heads)
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    first = np.nonzero(np.concatenate([[True], value[1:] != value[:-1]]))[0]
    n = np.diff(np.append(first, len(value)))
    for i, j in np.unique(np.stack([np.repeat(owner[first], n), owner], axis=1), axis=0).tolist():
        compare(i, j)
    for at, size in zip(first[n > 2].tolist(), n[n > 2].tolist(), strict=True):
        classes: dict[int, list[int]] = {}
        for i in owner[at : at + size].tolist():
            classes.setdefault(find(i), []).append(i)
        for one, other in combinations(classes.values(), 2):
            for i in one:
                for j in other:
                    compare(i, j)
    return np.array([find(i) for i in range(len(sets))], np.int64)


def _alike_links(slim: DataFrame, wanted: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: set_keys that link by exact similarity, as spanning stars.

    slim: doc_id, text_key, text of all rows. wanted: the sets to compare, each under the row that it is
    made of again, with the task (group, u, v) and the class that is known of it."""
    dealt = slim.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    dealt = dealt.withColumn("task", F.explode("tasks")).select("group", "task.u", "task.v", "set_key", "class", "text")
    dealt = dealt.repartition("group", "u", "v").sortWithinPartitions("group", "u", "v")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table in whole_groups(batches, ["group", "u", "v"]):
            keys, at = np.unique(table.column("set_key").to_numpy(), return_index=True)
            texts = table.column("text").cast(pa.binary())
            hashes = [np.unique(shingle_hashes(texts[int(i)].as_py() or b"", shingle)) for i in at]
            labels = alike(hashes, similarity, table.column("class").to_numpy()[at])
            other = np.nonzero(labels != np.arange(len(keys)))[0]
            yield _starred(other, labels[other], keys)

    return dealt.mapInArrow(lambda batches: _once(found(batches)), "a long, b long")


def _alike_components(docs: DataFrame, members: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """node, root: set_keys that reach each other within a group of members (doc_id, text_key, set_key,
    n_set, group) by exact similarity.

    First each block of a group by itself, with the group's pivot, its smallest set_key, in all of
    them. Then, of groups of several blocks, the sets outside the largest class so found, the rest,
    against the whole group: as that class is linked already, no pair is left out."""
    carrier = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("by")
    sets = stage(members.groupBy("group", "set_key").agg(F.max("n_set").alias("n_set"), carrier), "sets")
    room = F.greatest(F.ceil(F.sum("n_set") / BLOCK), F.ceil(F.count(F.lit(1)) / BLOCK_SETS))
    groups = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.least(room, F.count(F.lit(1))).cast("int").alias("blocks"), F.min("set_key").alias("pivot")).filter("n > 1")
    block = F.pmod(F.xxhash64("set_key", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    named = [F.col("by.doc_id").alias("_id"), F.col("by.text_key").alias("_key")]
    open_ = stage(join_one(sets, groups, "group").select("group", "set_key", "n_set", *named, "blocks", block, (F.col("set_key") == F.col("pivot")).alias("pivot")), "open")
    slim = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    task = lambda u, v: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: task(k, F.lit(0)))
    first = open_.withColumn("tasks", F.when(F.col("pivot"), everywhere).otherwise(F.array(task(F.col("block"), F.lit(0))))).withColumn("class", F.col("set_key"))
    found = stage(_alike_links(slim, first, shingle, similarity), "alike")
    several = open_.filter("blocks > 1")
    if not several.head(1):
        return connected_components(found)
    classes = several.join(connected_components(found), several["set_key"] == F.col("node"), "left").drop("node").withColumn("class", F.coalesce("root", "set_key")).drop("root")
    classes = stage(classes, "classes")
    sizes = classes.groupBy("group", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_set").alias("size"))
    room = F.greatest(F.ceil((F.sum("size") - F.max_by("size", F.struct("n", "class"))) / BLOCK), F.ceil((F.sum("n") - F.max("n")) / BLOCK_SETS)).cast("int")
    rest = sizes.groupBy("group").agg(F.max_by("class", F.struct("n", "class")).alias("main"), room.alias("rests")).filter("rests > 0")
    mixed = join_one(classes, rest, "group")
    own = F.pmod(F.xxhash64("set_key", F.lit("rest")), F.col("rests")).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: task(F.col("block"), k))
    as_rest = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: task(k, own))
    second = mixed.withColumn("tasks", F.when(F.col("class") == F.col("main"), as_member).otherwise(F.array_union(as_member, as_rest)))
    return connected_components(found.union(_alike_links(slim, second, shingle, similarity)))


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, bits: int = 64, budget: int = 2, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, text_key, fp, component_id, group for every row.

    Fingerprints of 64 * words bits link if they differ in max_bits bits or fewer and, in at least
    one band of `bits` bits, in budget bits or fewer (with one band of all bits: exactly max_bits).
    With similarity, what they link are candidates, and texts link if the Jaccard similarity of their
    sets of shingles is that or more; sets count as equal if their hashes of 64 bits are.
    group: one number for all that links, directly or not. component_id: its smallest doc_id; null
    ids count only where a group has no other."""
    found = stage(fingerprints(docs, shingle, words, id_col, text_col, similarity is not None), "fingerprints")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if words == 1 else F.xxhash64("fp")
    nodes = stage(first.select(node.alias("node"), "fp", "first"), "nodes")
    joined = connected_components(links(nodes, bits, budget, max_bits, words))
    rooted = nodes.join(joined, "node", "left").select("fp", F.coalesce("root", "node").alias("group"), "first")
    columns = ["doc_id", "text_key", "fp", "component_id", "group"]
    if similarity is None:
        rooted = stage(rooted, "rooted")
        smallest = rooted.groupBy("group").agg(F.min("first").alias("component_id"))
        return join_one(found, join_one(rooted, smallest, "group").select("fp", "component_id", "group"), "fp").select(*columns)
    members = stage(join_one(found, rooted.select("fp", "group"), "fp"), "members")
    exact = _alike_components(docs, members, shingle, similarity, id_col, text_col)
    sets = members.groupBy("set_key").agg(F.min("doc_id").alias("first"))
    rooted = stage(sets.join(exact, sets["set_key"] == exact["node"], "left").select("set_key", F.coalesce("root", "set_key").alias("group"), "first"), "rooted")
    smallest = rooted.groupBy("group").agg(F.min("first").alias("component_id"))
    return join_one(members.drop("group"), join_one(rooted, smallest, "group").select("set_key", "component_id", "group"), "set_key").select(*columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """docs with one row of each group: that of the smallest id (a null id stays only if alone).

    Rows that repeat an id and text are one; which of them stays, if they differ in other columns, is open."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    keep = best.select(F.col("best.doc_id").alias("doc_id"), F.col("best.text_key").alias("text_key")).distinct()
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(id_col).alias("id"), F.xxhash64(column(text_col).cast("string")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    return rows.join(keep, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")
