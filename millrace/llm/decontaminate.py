"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item becomes its item-sized windows. The words of a window are ordered by how rare
they are in the documents. A document that contains a window contains its rarest word, so the join
key is that word alone (the necessary prefix of a containment of everything). Each place where a
document has a window's prefix word fixes where the window would start; places where it would not
fit inside the document fall to the positional and length bounds. What is left is compared word by
word, and only exact containment counts. Rarity is counted over all documents.

The join has two forms. Windows of up to BROADCAST_WORDS words of items are broadcast, and documents read
them off in place. Beyond, both sides are shuffled by the prefix word: the places where documents have
one, with the words around them, and the windows; the places of a frequent word are dealt out by a salt.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import HOT_KEYS, HOT_ROWS, id_and_text, lists, merged_runs, stage, texts_of

#: Bytes that are not part of a word become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Words of benchmark items up to which their windows are broadcast (about 50 MB).
BROADCAST_WORDS = 1_000_000
#: Bits of the table by which documents tell words that may be a prefix.
FILTER_BITS = 1 << 22
#: Places of prefix words that a task holds before it sends them on.
PLACES = 20_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, letters a-z and everything beyond ASCII."""
    return text.translate(_FOLD).split()


class Windows:
    """The distinct windows of items, as numbers of words.

    table holds a window per row, length its number of words, items the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int) -> None:
        self.width = width
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for name, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + width]), set()).add(name)
        self.items = [list(v) for v in found.values()]
        self.length = np.fromiter(map(len, found), np.int64, len(found))
        self.table = np.full((len(found), width), -1, np.int32)
        for row, w in zip(self.table, found, strict=True):
            row[: len(w)] = w

    def order(self, counts: np.ndarray) -> None:
        """Fixes the prefix word of each window by the documents' counts."""
        rare = np.where(self.table >= 0, counts[self.table], np.iinfo(np.int64).max)
        self.by_rarity = np.argsort(rare, axis=1, kind="stable")
        prefix = self.table[np.arange(len(self.table)), self.by_rarity[:, 0]]
        self.by_prefix = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[self.by_prefix], np.arange(len(self.number) + 2))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """-1 for words of no item."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def within(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the document which windows start."""
        here = np.nonzero(self.first[ids + 1] > self.first[ids])[0] if len(self.number) else np.zeros(0, np.int64)
        here = here[ids[here] >= 0]
        word = ids[here]
        n = self.first[word + 1] - self.first[word]
        at, begin = np.repeat(here, n), np.cumsum(n) - n
        window = self.by_prefix[np.arange(int(n.sum())) - np.repeat(begin - self.first[word], n)]
        start = at - self.by_rarity[window, 0]
        fits = (start >= 0) & (start + self.length[window] <= len(ids))
        window, start = window[fits], start[fits]
        for k in range(1, self.width):
            if not len(window):
                break
            place = self.by_rarity[window, k]
            inside = place < self.length[window]
            same = ~inside | (ids[np.where(inside, start + place, 0)] == self.table[window, place])
            window, start = window[same], start[same]
        return window, start


def _counted(docs: DataFrame, block: Windows) -> np.ndarray:
    """How often each word of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        total = np.zeros(len(number) + 1, np.int64)
        get = number.get
        for batch in batches:
            for text in texts_of(batch):
                words = words_of(text)
                total += np.bincount(np.fromiter((get(w, len(number)) for w in words), np.int64, len(words)), minlength=len(total))
        used = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    counts = np.zeros(len(block.number) + 2, np.int64)
    for row in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # as many rows as the block has words
        counts[row["word"]] = row["n"]
    return counts


def _marked(docs: DataFrame, block: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in kept] + [*T.StructType.fromDDL("n_words long, starts array<long>, ends array<long>, items array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                window, start = block.within(block.numbers(words))
                begin, end = merged_runs(start, start + block.length[window])
                n_words.append(len(words))
                starts.append(begin)
                ends.append(end)
                items.append(sorted({name for w in set(window.tolist()) for name in block.items[w] if name is not None}))
            runs = np.fromiter(map(len, starts), np.int64, len(starts))
            spans = [lists(np.concatenate(x) if len(x) else np.zeros(0, np.int64), runs) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n_words, pa.int64()), *spans, pa.array(items, pa.list_(pa.string()))], schema.names)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_words: int = BROADCAST_WORDS, carry: bool = False) -> DataFrame:
    """doc_id, n_words, starts, ends, items for every row of docs; with carry also row, a struct of
    the input's columns.

    starts and ends are the maximal runs of words inside occurrences of windows; items the ids, as
    sorted text, of items with a window that occurs. An item of fewer than width words is one window.
    Null texts, and items without words, have none; an item with a null id marks words but is not
    listed, so items can be empty where starts is not. Repeated items count once. Without items nothing
    is contaminated."""
    text_key = F.xxhash64(F.col("row")[text_col] if carry else F.col("text"))
    slim, texts = id_and_text(docs, id_col, text_col, carry).withColumn("text_key", text_key), id_and_text(docs, id_col, text_col)
    listed = id_and_text(benchmark, item_col, item_text_col).select(F.col("doc_id").cast("string").alias("item"), "text")
    listed = stage(listed.mapInArrow(_item_words, "item string, words array<string>").filter(F.size("words") > 0), "items")
    total = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    if total > broadcast_words:
        return _joined(slim, _hits(texts.withColumn("text_key", F.xxhash64("text")), listed, width)).drop("text_key")
    block = Windows([(r["item"], [w.encode() for w in r["words"]]) for r in listed.collect()], width)  # broadcast_words words
    block.order(_counted(texts, block) if total else np.zeros(2, np.int64))
    return _marked(slim, block).drop("text_key")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[w.decode() for w in words_of(t)] for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.string()))], ["item", "words"])


def _hits(texts: DataFrame, listed: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, start, end, items: every occurrence of a window, by a shuffle on prefix words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(w for t in texts_of(batch) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    known = listed.select(F.explode("words").alias("word")).distinct()
    counts = texts.select("text").mapInArrow(count, "word string, n long").join(known, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    windows = listed.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k + 1, width))).alias("window"))
    windows = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    places = windows.select("window", "items", F.posexplode("window").alias("place", "word"))
    rarest = F.min(F.struct("n", "place", "word")).alias("p")  # a window with a word that no document has cannot occur
    ranked = places.join(counts, "word").groupBy("window").agg(rarest, F.count(F.lit(1)).alias("found"), F.first("items").alias("items")).filter(F.col("found") == F.size("window"))
    ranked = stage(ranked.select("window", "items", "p.n", "p.place", F.col("p.word").alias("word")), "windows")
    bits = ranked.select((F.crc32(F.encode("word", "utf-8")) % FILTER_BITS).cast("int").alias("bit")).distinct().collect()  # FILTER_BITS at most
    table = np.zeros(FILTER_BITS, bool)
    table[[r["bit"] for r in bits]] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(table))
    schema = T.StructType([T.StructField("word", T.StringType()), texts.schema["doc_id"], *T.StructType.fromDDL("text_key long, at int, left int, around array<string>").fields])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = np.unpackbits(shared.value).view(bool)

        def sent(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
            row, word, at, left, around = zip(*held, strict=True) if held else ((),) * 5
            take = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(at, pa.int32()), pa.array(left, pa.int32()), pa.array(around, pa.list_(pa.string()))], schema.names)

        for batch in batches:
            held: list[tuple] = []
            for k, t in enumerate(texts_of(batch)):
                words = words_of(t)
                for at, w in enumerate(words):
                    if likely[zlib.crc32(w) % FILTER_BITS]:
                        begin = max(0, at - width + 1)
                        held.append((k, w.decode(), at, at - begin, [x.decode() for x in words[begin : at + width]]))
                    if len(held) >= PLACES:
                        yield sent(batch, held)
                        held = []
            yield sent(batch, held)

    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    often = stage(ranked.filter(F.col("n") > HOT_ROWS).select("word", parts.alias("parts")).distinct(), "often")
    often = F.broadcast(often) if often.count() <= HOT_KEYS else often
    there = texts.mapInArrow(occurrences, schema).join(often, "word", "left")
    there = there.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "at"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    size = F.size("window")
    fits = (F.col("left") >= F.col("place")) & (F.size("around") - F.col("left") >= size - F.col("place"))
    same = F.when(fits, F.slice("around", F.col("left") - F.col("place") + 1, size) == F.col("window"))
    start = (F.col("at") - F.col("place")).cast("long")
    return there.join(dealt, ["word", "salt"]).filter(same).select("doc_id", "text_key", start.alias("start"), (start + size).alias("end"), "items")


def _joined(slim: DataFrame, hits: DataFrame) -> DataFrame:
    """Every row with its number of words and its hits. Only rows with hits meet, by id and text."""
    kept = [c for c in slim.columns if c != "text"]
    schema = T.StructType([slim.schema[c] for c in kept] + [T.StructField("n_words", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n, pa.int64())], schema.names)

    every, key = slim.mapInArrow(count, schema), ["doc_id", "text_key"]
    merged = hits.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").alias("starts"), F.col("end").alias("ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"),
    )
    last = lambda acc: F.element_at(acc, -1)
    grown = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<starts: bigint, ends: bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["ends"] >= x["starts"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["starts"].alias("starts"), F.greatest(last(acc)["ends"], x["ends"]).alias("ends")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.select(*key, grown.alias("grown"), "all_items")
    none = F.expr("cast(array() as array<bigint>)")
    meets = F.col("e.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("e.text_key") == F.col("m.text_key"))
    return every.alias("e").join(merged.alias("m"), meets, "left").select(
        *[f"e.{c}" for c in every.columns],
        F.coalesce("grown.starts", none).alias("starts"), F.coalesce("grown.ends", none).alias("ends"),
        F.coalesce("all_items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
