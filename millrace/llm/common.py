"""What the operators of this subpackage share: column access, shared storage and packing.

Rules that hold for every operator here:

* Only the named id and text columns are read, under internal names, so further columns, whatever
  they are called, neither matter nor clash.
* A null text counts as an empty one unless the operator says otherwise. A null id is carried
  through; it never represents a group.
* An empty table gives an empty result of the same schema.
* Repeated rows are rows of their own: each gets its result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shipping import ship

#: ASCII white space, as the word definitions of the operators use it: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def column(name: str) -> Column:
    """The top-level column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """The two columns that an operator reads, as doc_id and text. With carry the text comes inside
    row, a struct of all columns in which it is the first and the others follow in their order."""
    ship(docs.sparkSession)
    if not carry:
        return docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    rest = [column(c) for c in docs.columns if c != text_col]
    return docs.select(column(id_col).alias("doc_id"), F.struct(column(text_col).cast("string").alias(text_col), *rest).alias("row"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column of what id_and_text selected."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a temporary one in local mode,
    as in tests; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def _shuffles_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Open lists of what is staged.
_MADE: list[list[str]] = []


@contextmanager
def listed_stages() -> Iterator[list[str]]:
    """The paths of all tables that are staged while the block runs, in order."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def drop_stages(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs start from these files, so a
    lost executor costs a re-read and not the whole lineage. The job's shuffle files go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_the_job(spark):
        df.write.option("compression", "zstd").parquet(path)
    for made in _MADE:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a shuffled join gives one task; the rows of more frequent keys stay where they are.
HOT_ROWS = 100_000
#: Frequent keys whose partners are broadcast, at most.
HOT_KEYS = 1_000_000


def frequent(rows: DataFrame, on: str, limit: int = HOT_ROWS) -> DataFrame | None:
    """The keys of more than limit rows, or None if there are none. Up to HOT_KEYS of them are marked for
    broadcast; if there are more, no key holds much of the table, and joins with them are shuffled."""
    often = stage(rows.groupBy(on).count().filter((F.col("count") > limit) & F.col(on).isNotNull()).select(on), "frequent")
    n = often.count()
    return None if not n else F.broadcast(often) if n <= HOT_KEYS else often


def join_one(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has a key once at most; left is a staged table, how inner or left.

    Rows of a key of more than HOT_ROWS do not meet in one task: they stay where they are, and the
    partner, if not too many keys are like that, is broadcast."""
    often = frequent(left, on) if left.count() > HOT_ROWS else None
    if often is None:
        return left.join(right, on, how)
    partners = right.join(often, on, "left_semi")
    if often.count() <= HOT_KEYS:
        partners = F.broadcast(partners)
    hot = left.join(often, on, "left_semi").join(partners, on, how)
    return hot.unionByName(left.join(often, on, "left_anti").join(right, on, how))


def clear_stages(spark: SparkSession) -> None:
    """Deletes all that this application staged; results that were not written yet cannot be read then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The text column as UTF-8, null as empty."""
    return [v or b"" for v in text_of(batch).cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """Consecutive runs of values as an Arrow list column."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of about so many rows that begin and end with a value of by; the rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) > rows:
            table = pa.Table.from_batches(held)
            new = np.zeros(table.num_rows - 1, bool)
            for name in by:
                values = table.column(name).to_numpy()
                new |= values[1:] != values[:-1]
            ends = np.nonzero(new)[0] + 1
            done = 0
            for end in ends.tolist():
                if end - done >= rows:
                    yield table.slice(done, end - done).combine_chunks()
                    done = end
            held = table.slice(done).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def merged_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that half-open spans cover; runs that touch are one."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), np.maximum.accumulate(end[order]).astype(np.int64)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(end) - 1]])]


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
