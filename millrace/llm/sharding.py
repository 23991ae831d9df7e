"""Sharding by best-fit-decreasing bin packing.

Rows of equal text form a group that stays in one shard. Groups enter the fullest shard that still
has room for them, the largest first; the shards stand in a balanced tree ordered by the room left.

What is packed is a list of items. With one unit = capacity / resolution, the items are: each group of
a unit or more by itself; smaller groups in bundles of about a unit, made of groups of similar row
size; and groups larger than a shard, which no shard can hold whole, split by a hash of the row's id
into parts of about a unit.

For a number of shards the packing is one sequence, on the driver, over a list whose length depends on
that number and the resolution alone. For a capacity the number of shards grows with the data, so items
are dealt out by hash into parcels of PARCEL shards' worth, each packed in a task; of what a parcel
opens at most one shard is half empty or more, and those are packed together at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import id_and_text, join_one, stage, whole_groups

#: Rows that one task numbers within a shard.
SLOT_ROWS = 16_384
#: Shards' worth of items that one task packs for a capacity.
PARCEL = 64


class RoomTree:
    """A treap of (room, bin): finds the least room that is enough in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] >= b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        left, right = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(left, [(room, number), hash((room * 0x9E3779B1, number)), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin of the least room >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        first = right
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(right, (first[0][0], first[0][1] + 1))
        self.root = self._merge(left, rest)
        return first[0]


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each size. Without bins, as many are opened as needed, and a size over the
    capacity gets a bin of its own; with bins, what fits nowhere goes where most room is left."""
    sizes = list(sizes)
    tree, where, opened = RoomTree(), [0] * len(sizes), bins or 0
    for b in range(opened):
        tree.add(capacity, b)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None and bins is None:
            found = (max(capacity, sizes[i]), opened)
            opened += 1
        elif found is None:
            node = tree.root
            while node[3] is not None:
                node = node[3]
            found = node[0]
            left, _ = tree._split(tree.root, found)
            tree.root = left
        where[i] = found[1]
        tree.add(found[0] - sizes[i], found[1])
    return where


def size_class(size: Column) -> Column:
    """Sizes that differ by less than a fifth or so share a class."""
    return F.floor(F.log2(size.cast("double")) * 4).cast("long")


def _in_parcels(items: DataFrame, room: int, parcels: int) -> DataFrame:
    """x, y, z, shard: as few shards of that room as best fit finds in parcels. The driver gets a
    number or two for each parcel."""
    spark = items.sparkSession
    dealt = items.withColumn("parcel", F.pmod(F.xxhash64("x", "y", "z", F.lit("parcel")), F.lit(parcels)).cast("int"))
    dealt = dealt.repartition("parcel").sortWithinPartitions("parcel", F.desc("bytes"), "x", "y", "z")
    names = ["x", "y", "z", "bytes", "parcel", "bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["parcel"]):
            parcel, size = table.column("parcel").to_numpy(), table.column("bytes").to_pylist()
            first = np.nonzero(np.concatenate([[True], parcel[1:] != parcel[:-1]]))[0].tolist()
            where = [b for at, upto in zip(first, [*first[1:], len(parcel)], strict=True) for b in best_fit_decreasing(size[at:upto], room)]
            yield from table.select(names[:-1]).append_column("bin", pa.array(where, pa.int32())).to_batches()

    bins = stage(dealt.select(*names[:-1]).mapInArrow(run, "x long, y long, z long, bytes long, parcel int, bin int"), "bins")
    fill = bins.groupBy("parcel", "bin").agg(F.sum("bytes").alias("fill"))
    full = fill.filter(2 * F.col("fill") > room)
    begin, at = [], 0
    for r in sorted(full.groupBy("parcel").count().collect()):  # one for each parcel
        begin.append((r["parcel"], at))
        at += r["count"]
    number = F.row_number().over(Window.partitionBy("parcel").orderBy("bin")) - 1
    numbered = full.withColumn("number", number).join(F.broadcast(spark.createDataFrame(begin, "parcel int, begin int")), "parcel").select("parcel", "bin", (F.col("number") + F.col("begin")).alias("shard"))
    rest = sorted(fill.filter(2 * F.col("fill") <= room).collect())  # one for each parcel at most
    ends = [(r["parcel"], r["bin"], at + b) for r, b in zip(rest, best_fit_decreasing([r["fill"] for r in rest], room), strict=True)]
    return bins.join(numbered.union(spark.createDataFrame(ends, "parcel int, bin int, shard int")), ["parcel", "bin"]).select("x", "y", "z", "shard")


def pack(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, resolution: int = 512, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; with carry also row, a struct of its columns.

    Give shards for that many shards of near equal bytes, or capacity for as few shards of that
    many bytes as best fit finds. size is the text's UTF-8 bytes and one; a null text has size 1 and
    the checksum of an empty one, but forms a group apart from empty texts. A text larger than the
    capacity has a shard of its own. slot runs from 0 without gaps in each shard, by id as far as rows
    share a block. Repeated rows and null ids are rows like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("row")[text_col] if carry else F.col("text")
    rows = id_and_text(docs, id_col, text_col, carry).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.struct(F.xxhash64(text, text.isNull()).alias("a"), F.xxhash64(F.lit("second"), text, text.isNull()).alias("b")).alias("g"),
        F.monotonically_increasing_id().alias("at"),
        *(["row"] if carry else []),
    )
    whole = stage(rows, "rows")
    rows = whole.drop("row")
    found = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    total, n = found["bytes"] or 0, found["n"]
    room = capacity or max(1, math.ceil(total / shards))
    unit = max(1, room // resolution)
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    parts = F.when(F.col("bytes") > room, F.ceil(F.col("bytes") / unit)).otherwise(F.lit(1)).cast("long").alias("parts")
    big = stage(groups.filter(F.col("bytes") >= unit).select("g", parts), "groups")
    known = join_one(rows, big, "g", "left")
    kind = F.when(F.col("parts").isNull(), size_class(F.col("size")))
    classes = known.filter("parts is null").groupBy(size_class(F.col("size")).alias("k")).agg(F.sum("size").alias("bytes")).collect()  # four for each power of two
    share = {r["k"]: math.ceil(r["bytes"] / unit) for r in classes} or {0: 1}
    bundles = F.create_map(*[F.lit(x).cast("long") for pair in share.items() for x in pair])
    salt = F.xxhash64(F.lit("part"), "doc_id", "at")
    item = [
        F.when(kind.isNull(), F.col("g.a")).otherwise(kind).alias("x"),
        F.when(kind.isNull(), F.col("g.b")).otherwise(F.pmod(F.col("g.a"), F.coalesce(F.element_at(bundles, kind), F.lit(1).cast("long")))).alias("y"),
        F.when(kind.isNull(), F.pmod(salt, F.col("parts"))).otherwise(F.lit(-1)).cast("long").alias("z"),
    ]
    keyed = known.select("doc_id", "size", "text_crc32", "at", *item)
    items = keyed.groupBy("x", "y", "z").agg(F.sum("size").alias("bytes"))
    if capacity:
        places = stage(_in_parcels(items, room, max(1, math.ceil(total / (room * PARCEL)))), "places")
        opened = (places.agg(F.max("shard")).first()[0] or 0) + 1
    else:
        # no more groups of a unit or more, nor bundles and parts, fit in the total: a few for each unit
        listed = sorted(items.collect(), key=lambda r: (-r["bytes"], r["x"], r["y"], r["z"]))
        where = best_fit_decreasing([r["bytes"] for r in listed], room, shards)
        places = F.broadcast(spark.createDataFrame([(r["x"], r["y"], r["z"], s) for r, s in zip(listed, where, strict=True)], "x long, y long, z long, shard int"))
        opened = shards
    blocks = max(1, math.ceil(n / (opened * SLOT_ROWS)))
    placed = keyed.join(places, ["x", "y", "z"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "at", F.lit("block")), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "at")
    slotted = placed.withColumn("number", F.row_number().over(within)).join(offsets, ["shard", "block"])
    made = slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("number") - 1 + F.col("offset")).cast("long").alias("slot"), "at")
    return (made.join(whole.select("at", "row"), "at") if carry else made).drop("at")


def write_shards(docs: DataFrame, path: str, **how: object) -> None:
    """Packs docs as pack does and writes each shard to a folder shard=N of path, its rows in slot order.

    All rows are written once, those of repeated and null ids too. A column of docs that is called shard
    gives way to the folder's."""
    packed = pack(docs, carry=True, **how)
    rows = packed.select("shard", "slot", *[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")])
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
