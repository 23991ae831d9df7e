"""Removal of byte strings that repeat across documents, by distributed prefix doubling.

A byte goes if a string of `length` bytes that covers it also starts in a document of smaller id.

Prefix doubling names strings of doubled length by pairs of names, and drops what is unique on the
way. Here a name is a 64-bit hash of the pair, which needs no sort to be the same everywhere, and the
global rounds are two:

1. Ranks at length k, about half of `length`, at anchors only. Each window of `length` bytes has as
   its anchor the place in it whose k-byte name is least, so equal windows have equal anchors at equal
   offsets; one place in fourteen or so is an anchor. Spark deals the names out and keeps those that
   two documents share. Names that are unique are past the threshold and leave here, nine in ten.
2. Ranks at full length, for the windows of the anchors left. Each anchor brings the bytes that its
   windows cover; Spark deals the anchors out by name and sorts them, and windows of one name and
   offset are compared by a second name, of all their bytes.

What repeats within a batch of documents is combined before it is dealt out: a name goes out once
for each batch, and equal surroundings of a name go out for the smallest document only. A name that
still has more than HOT surroundings is resolved by its windows, each a key of its own. What a task
finds covered leaves it merged, as one row for each bucket of documents.

Names of all positions, ranked by a sort in each round, would put 16 bytes for every byte of text
through a shuffle in every round; the anchors put through half a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import column, frequent, id_and_text, join_one, lists, merged_runs, ranges, stage, text_of, texts_of, unstage, whole_groups
from millrace.shipping import ship

#: Surroundings of one name that one task compares; more are dealt out by window.
HOT = 50_000
#: Bytes of text that a task handles at a time, and spans that it holds to merge them.
CHUNK, SPANS = 1 << 22, 400_000
#: Bytes of text whose names a task compares at a time: the share of one bucket.
BUCKET = 32 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names, in this order."""
    h = (a * _M1) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def names(data: np.ndarray, k: int) -> np.ndarray:
    """A name for each string of k bytes of data: doubled up to the last power of two, then of the
    two such strings that cover the k bytes."""
    h, size = data.astype(np.uint64), 1
    while size * 2 <= k:
        h = _pair(h[:-size], h[size:])
        size *= 2
    return h if size == k else _pair(h[: len(h) - (k - size)], h[k - size :])


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each run of width values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return x if size == width else f(x[: len(x) - (width - size)], x[width - size :])


class Anchors:
    """The anchors of one text: place and name of each, and the windows that are its own.

    Windows first .. last of an anchor are those whose least name, the leftmost if several, is its."""

    def __init__(self, text: bytes, length: int) -> None:
        data = np.frombuffer(text, np.uint8)
        k = (length + 1) // 2
        width = length - k + 1
        none = np.zeros(0, np.int64)
        self.place, self.name, self.first, self.last = none, none, none, none
        if len(data) < length:
            return
        name = names(data, k)
        least = _sliding(name, width, np.minimum)
        # the window's anchor: the next place from its start on with that least name
        window = np.arange(len(least))
        place = _first_equal(name, least, width)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        self.first = window[new]
        self.last = np.append(self.first[1:], len(least)) - 1
        self.place = place[new]
        self.name = name[self.place].view(np.int64)


def _first_equal(name: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """For each window the first place in it with its least name. It never moves back."""
    # a place is the least of some window if it equals the greatest of the least names of its windows
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.nonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == name)[0]
    # candidates in order; walk windows to the first candidate at or after their start that is equal
    at = np.searchsorted(chosen, np.arange(len(least)))
    while True:
        places = chosen[at]
        wrong = name[places] != least
        if not wrong.any():
            return places
        at[wrong] += 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of text."""
    for batch in batches:
        at = 0
        size = np.cumsum(pc.fill_null(pc.binary_length(text_of(batch)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_by[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.nonzero(new)[0]


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where runs that begin at first end."""
    return np.append(first[1:], n) if len(first) else first


def _by_doc(doc: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each document with its values packed."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    first = _starts(doc)
    for a, b in zip(first, _ends(first, len(doc)), strict=True):
        yield int(doc[a]), values[a:b].tobytes()


def _shared_names(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc, names (packed): anchor names of a document that another document has too.

    Names are dealt out by their low bits and told apart there by their upper 32. Inside a chunk of
    documents a name that several have is theirs at once, and goes out once for all of them."""
    low = np.uint64(buckets - 1)
    short = low | np.uint64(0xFFFFFFFF00000000)
    schema = "bucket int, kind int, docs binary, names binary"
    columns = ["bucket", "kind", "docs", "names"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            ids = batch.column("doc").to_numpy()
            found = [np.unique(Anchors(t, length).name).view(np.uint64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            name, doc = np.concatenate(found), np.repeat(ids, [len(x) for x in found])
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            first = _starts(name)
            count = np.diff(np.append(first, len(name)))
            shared = doc[first] != doc[first + count - 1]
            out: list[tuple] = []
            local = np.repeat(shared, count)
            out += [(d & int(low), 1, np.int64(d).tobytes(), packed) for d, packed in _by_doc(doc[local], name[local] & short)]
            name, doc = name[first], doc[first]
            bucket = (name & low).astype(np.int64)
            order = np.lexsort((doc, bucket))
            bucket, upper, doc = bucket[order], (name[order] >> np.uint64(32)).astype(np.uint32), doc[order]
            first = _starts(bucket)
            out += [(int(bucket[a]), 0, doc[a:b].tobytes(), upper[a:b].tobytes()) for a, b in zip(first, _ends(first, len(bucket)), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], columns)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            kind = table.column("kind").to_numpy()
            docs, names = table.column("docs").to_pylist(), table.column("names").to_pylist()
            out = [(int(np.frombuffer(docs[k], np.int64)[0]), names[k]) for k in np.nonzero(kind == 1)[0]]
            bucket = table.column("bucket").to_numpy()
            for b in np.unique(bucket[kind == 0]):
                mine = np.nonzero((kind == 0) & (bucket == b))[0]
                upper = np.frombuffer(b"".join(names[k] for k in mine), np.uint32)
                doc = np.frombuffer(b"".join(docs[k] for k in mine), np.int64)
                order = np.argsort(upper, kind="stable")
                upper, doc = upper[order], doc[order]
                first = _starts(upper)
                apart = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                apart = np.repeat(apart, np.diff(np.append(first, len(upper))))
                out += _by_doc(doc[apart], upper[apart].astype(np.uint64) << np.uint64(32) | np.uint64(b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["doc", "names"])

    return rows.mapInArrow(send, schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "doc long, names binary")


_AROUND = "kind int, bucket int, name long, doc long, text_key long, start int, n int, rel int, around binary"
_SPAN = np.dtype([("doc", np.int64), ("key", np.int64), ("start", np.int32), ("end", np.int32)])


def _merged(*parts: np.ndarray) -> np.ndarray:
    """Spans (rows of _SPAN) in order, merged within each document and text."""
    spans = np.concatenate(parts) if parts else np.zeros(0, _SPAN)
    spans = spans[np.lexsort((spans["key"], spans["doc"]))]
    first = _starts(spans["doc"], spans["key"])
    apart = int(spans["end"].max(initial=0)) + 2  # so far apart that spans of different texts never touch
    shift = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(spans)))) * apart
    start, end = merged_runs(spans["start"] + shift, spans["end"] + shift)
    group = start // apart
    made = np.zeros(len(start), _SPAN)
    made["doc"], made["key"] = spans["doc"][first[group]], spans["key"][first[group]]
    made["start"], made["end"] = start - group * apart, end - group * apart
    return made


def _span_rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    made = np.zeros(len(doc), _SPAN)
    made["doc"], made["key"], made["start"], made["end"] = doc, key, start, end
    return made


def _by_bucket(spans: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets of documents, and for each its spans, packed."""
    bucket = (_pair(spans["doc"].view(np.uint64), spans["key"].view(np.uint64)) & np.uint64(buckets - 1)).astype(np.int32) if len(spans) else np.zeros(0, np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, spans = bucket[order], spans[order]
    first = _starts(bucket)
    return bucket[first], [spans[a:b].tobytes() for a, b in zip(first, _ends(first, len(bucket)), strict=True)]


def _at_the_end(found: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, packed: the spans that a task finds, merged as far as SPANS of them are held at a time."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        bucket, packed = _by_bucket(_merged(*held), buckets)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    for spans in found:
        held.append(spans)
        if sum(map(len, held)) > SPANS:
            held = [_merged(*held)]
            if len(held[0]) > SPANS // 2:
                yield out()
                held = []
    yield out()
    pa.default_memory_pool().release_unused()


def _surroundings(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """For each anchor of a shared name (kind 1) the bytes that its windows cover, and where they
    start; where equal bytes stand in a smaller document of the chunk, the span itself, packed (kind 0)."""
    short = np.uint64(buckets - 1) | np.uint64(0xFFFFFFFF00000000)
    names_of = [f.split()[0] for f in _AROUND.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            around: list[bytes] = []
            for d, k, text, packed in zip(batch.column("doc").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("names").to_pylist(), strict=True):
                a = Anchors(text, length)
                mine = np.isin(a.name.view(np.uint64) & short, np.frombuffer(b"".join(packed), np.uint64))
                name, place, first, last = a.name[mine], a.place[mine], a.first[mine], a.last[mine]
                for held, x in zip(cols, (name, np.full(len(name), d), np.full(len(name), k), first, last - first + 1, place - first), strict=True):
                    held.append(x)
                around += [text[f : e + length] for f, e in zip(first.tolist(), last.tolist(), strict=True)]
            name, doc, key, start, n, rel = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            seen = np.fromiter(map(xxhash.xxh64_intdigest, around), np.uint64, len(around))
            order = np.lexsort((doc, seen, name))
            first = _starts(name[order], seen[order])
            least = np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
            covered = np.zeros(len(order), bool)
            covered[order] = doc[order] > least
            send = np.nonzero(~covered)[0]
            columns = [np.ones(len(send)), np.zeros(len(send)), *(x[send] for x in (name, doc, key, start, n, rel))]
            made = [pa.array(x if x.dtype == np.int64 and t == pa.int64() else x.astype(np.int32), t) for x, t in zip(columns, kinds[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([*made, pa.array([around[i] for i in send], pa.binary())], names_of)
            bucket, packed = _by_bucket(_merged(_span_rows(doc[covered], key[covered], start[covered], (start + n - 1 + length)[covered])), buckets)
            made = [pa.array(np.zeros(len(bucket), np.int32)), pa.array(bucket, pa.int32()), *(pa.nulls(len(bucket), t) for t in kinds[2:-1])]
            yield pa.RecordBatch.from_arrays([*made, pa.array(packed, pa.binary())], names_of)

    return rows.mapInArrow(run, _AROUND)


def _windows(table: pa.Table | pa.RecordBatch, pick: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of the picked rows: the row, and a name of its bytes and its offset."""
    rows, n = pick, table.column("n").to_numpy()[pick].astype(np.int64)
    around = table.column("around").to_pylist()
    data = np.frombuffer(b"".join(around[i] for i in pick), np.uint8)
    size = n + length - 1
    at = ranges(np.cumsum(size) - size, n)
    offset = np.repeat(table.column("rel").to_numpy()[pick].astype(np.int64), n) - ranges(np.zeros(len(n), np.int64), n)
    full = names(data, length)[at] if len(at) else np.zeros(0, np.uint64)
    return np.repeat(rows, n), _pair(full, offset.astype(np.uint64)).view(np.int64)


def _resolved(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, packed: spans of what windows of the same name in smaller documents cover."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for table in whole_groups(batches, ["name"], 20_000):
            name, doc, key = (table.column(c).to_numpy() for c in ("name", "doc", "text_key"))
            start, n = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
            seen = np.fromiter(map(xxhash.xxh64_intdigest, table.column("around").to_pylist()), np.uint64, len(name))
            order = np.lexsort((doc, seen, name))
            first = _starts(name[order], seen[order])
            covered = np.zeros(len(name), bool)
            covered[order] = doc[order] > np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
            # of rows with equal surroundings the smallest document speaks for all
            open_ = np.nonzero(~covered)[0]
            open_ = open_[np.isin(name[open_], name[open_][_again(name[open_])])]
            row, window = _windows(table, open_, length)
            order = np.lexsort((doc[row], window, name[row]))
            r, w = row[order], window[order]
            first = _starts(name[r], w)
            gone = np.zeros(len(row), bool)
            gone[order] = doc[r] > np.repeat(doc[r[first]], np.diff(np.append(first, len(r))))
            at = ranges(start[open_], n[open_])[gone]
            whole = _span_rows(doc[covered], key[covered], start[covered], (start + n - 1)[covered] + length)
            yield _merged(whole, _span_rows(doc[row[gone]], key[row[gone]], at, at + length))

    slim = rows.select("name", "doc", "text_key", "start", "n", "rel", "around")
    return slim.repartition("name").sortWithinPartitions("name").mapInArrow(lambda batches: _at_the_end(found(batches), buckets), "bucket int, packed binary")


def _again(values: np.ndarray) -> np.ndarray:
    """True where a value of a sorted array equals a neighbour."""
    same = values[1:] == values[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(values) else np.zeros(0, bool)


def _resolved_by_window(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """As _resolved, for hot names: every window is a key of its own and goes to the bucket of its
    low bits (kind 1). Of equal windows in a batch only the smallest document's goes out, packed; the
    others are covered at once (kind 0)."""
    entry = np.dtype([("window", np.int64), ("doc", np.int64), ("key", np.int64), ("start", np.int32)])

    def covers(made: np.ndarray) -> np.ndarray:
        return _merged(_span_rows(made["doc"], made["key"], made["start"], made["start"] + length))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, window = _windows(batch, np.arange(batch.num_rows), length)
            name, doc, key, start, n = (batch.column(c).to_numpy() for c in ("name", "doc", "text_key", "start", "n"))
            made = np.zeros(len(row), entry)
            made["window"] = _pair(name[row].view(np.uint64), window.view(np.uint64)).view(np.int64)
            made["doc"], made["key"], made["start"] = doc[row], key[row], ranges(start.astype(np.int64), n.astype(np.int64))
            made = made[np.lexsort((made["doc"], made["window"]))]
            gone = _above_least(made["window"], made["doc"])
            ready, spans = _by_bucket(covers(made[gone]), buckets)
            made = made[~gone]
            made = made[np.lexsort((made["doc"], made["window"] & (buckets - 1)))]
            bucket = made["window"] & (buckets - 1)
            first = _starts(bucket)
            packed = [made[a:b].tobytes() for a, b in zip(first, _ends(first, len(made)), strict=True)]
            kind = np.repeat(np.array([0, 1], np.int32), [len(ready), len(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ready, bucket[first].astype(np.int32)])), pa.array(kind), pa.array(spans + packed, pa.binary())], ["bucket", "kind", "packed"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for table in whole_groups(batches, ["bucket"]):
            kind, packed = table.column("kind").to_numpy(), table.column("packed").to_pylist()
            yield np.frombuffer(b"".join(p for p, k in zip(packed, kind, strict=True) if not k), _SPAN)
            made = np.frombuffer(b"".join(p for p, k in zip(packed, kind, strict=True) if k), entry)
            made = made[np.lexsort((made["doc"], made["window"]))]
            yield covers(made[_above_least(made["window"], made["doc"])])

    sent = rows.select("name", "doc", "text_key", "start", "n", "rel", "around").mapInArrow(send, "bucket int, kind int, packed binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _at_the_end(found(batches), buckets), "bucket int, packed binary")


def _above_least(sorted_key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows of a key have a larger document than its first row."""
    first = _starts(sorted_key)
    return doc > np.repeat(doc[first], np.diff(np.append(first, len(doc))))


def _gathered(packed: DataFrame) -> DataFrame:
    """One row for each document and text, its spans merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            made = _merged(np.frombuffer(b"".join(table.column("packed").to_pylist()), _SPAN))
            first = _starts(made["doc"], made["key"])
            n = np.diff(np.append(first, len(made)))
            both = [lists(made[c], n, pa.int32()) for c in ("start", "end")]
            yield pa.RecordBatch.from_arrays([pa.array(made["doc"][first]), pa.array(made["key"][first]), *both], ["doc", "text_key", "starts", "ends"])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, text_key long, starts array<int>, ends array<int>")


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_key, starts, ends: the runs of bytes that a string of `length` bytes in
    a smaller document covers. doc is the id, a null one as the largest number."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(column(id_col).cast("long"), F.lit(2**63 - 1))
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text")).filter(F.octet_length("text") >= length)
    # whole copies first: a later copy of a text goes as a whole and need not be looked into
    slim = stage(rows.select("doc", "text_key", F.concat_ws(":", "text_key", F.xxhash64(F.lit("second"), "text"), F.octet_length("text")).alias("copy"), F.octet_length("text").alias("size")), "copies")
    total = slim.agg(F.sum("size")).first()[0] or 0
    copied = slim.groupBy("copy").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("copy", "least")
    copies = stage(join_one(slim, copied, "copy").filter("doc > least").select("doc", "text_key", "size").distinct(), "copies")
    buckets = 16
    while buckets * BUCKET < total:
        buckets *= 2
    alone = rows.join(copies.select("doc", "text_key"), ["doc", "text_key"], "left_anti")
    shared = stage(_shared_names(alone, length, buckets), "names")
    gathered = shared.groupBy("doc").agg(F.collect_list("names").alias("names"))
    looked = rows.join(gathered.hint("shuffle_hash"), "doc").join(copies.select("doc", "text_key"), ["doc", "text_key"], "left_anti")
    around = stage(_surroundings(looked.select("doc", "text_key", "text", "names"), length, buckets), "surroundings")
    unstage(shared)
    open_ = around.filter("kind = 1")
    hot = frequent(open_, "name", HOT)
    if hot is None:
        packed = _resolved(open_, length, buckets)
    else:
        packed = _resolved(open_.join(hot, "name", "left_anti"), length, buckets).union(_resolved_by_window(open_.join(hot, "name", "left_semi"), length, buckets))
    packed = packed.union(around.filter("kind = 0").select("bucket", F.col("around").alias("packed")))
    whole = stage(_gathered(packed).union(copies.select("doc", "text_key", F.array(F.lit(0)), F.array("size"))), "spans")
    unstage(around)
    return whole


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (binary), starts, ends for every row of docs; with carry also row, a
    struct of the input's columns, and kept_text, without characters that lost some of their bytes.

    starts and ends are the maximal runs removed, in bytes of the text. Null and empty texts have no
    bytes. A null id counts as larger than any other, and rows of one id take nothing from each
    other. Strings are told apart by names of 128 bits together."""
    spans = repeated_spans(docs, length, id_col, text_col)
    doc = F.coalesce(column("doc_id").cast("long"), F.lit(2**63 - 1))
    full = id_and_text(docs, id_col, text_col, carry)
    text = F.col("row")[text_col] if carry else F.col("text")
    full = full.withColumns({"doc": doc, "text_key": F.xxhash64(F.coalesce(text, F.lit("")))})
    joined = full.join(spans.hint("shuffle_hash"), ["doc", "text_key"], "left").drop("doc", "text_key")
    # null lists would make Spark's Arrow writer fill all offsets anew for each row
    none = F.expr("cast(array() as array<int>)")
    joined = joined.withColumns({"starts": F.coalesce("starts", none), "ends": F.coalesce("ends", none)})
    carried = ["doc_id", "row"] if carry else ["doc_id"]
    schema = T.StructType([joined.schema[c] for c in carried] + T.StructType.fromDDL("n_bytes long, kept binary, starts array<long>, ends array<long>" + ", kept_text string" * carry).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            kept, size, starts, ends = [], [], [], []
            for text, s, e in zip(texts_of(batch), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                first, last = merged_runs(np.array(s or [], np.int64), np.array(e or [], np.int64))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)) if len(first) else text)
                size.append(len(text))
                starts.append(first)
                ends.append(last)
            runs = np.fromiter(map(len, starts), np.int64, len(starts))
            both = [lists(np.concatenate(x) if x else np.zeros(0, np.int64), runs, pa.int64()) for x in (starts, ends)]
            as_text = [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] if carry else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(size, pa.int64()), pa.array(kept, pa.binary()), *both, *as_text], schema.names)

    return joined.mapInArrow(run, schema)
