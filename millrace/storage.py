"""Small files on any of Hadoop's file systems, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path in its own terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str | None:
    """What a file holds; None if there is none."""
    fs, where = filesystem(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Writes a file beside and gives it its name when it is whole, so no reader meets half of it.
    Without overwrite, False if the name is taken. The rename refuses a name that is taken on HDFS and,
    as a hard link, on local disks; object stores without conditional writes need a lock of their own."""
    fs, where = filesystem(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.getUri().getScheme() == "file":
        source, target = beside.toUri().getPath(), where.toUri().getPath()
        try:
            os.replace(source, target) if overwrite else os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(beside, False)  # with its checksum file
    how = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if overwrite else getattr(how, "NONE")
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, where, options)
        return True
    except Exception as e:
        fs.delete(beside, False)
        if overwrite or "AlreadyExists" not in str(e):
            raise
        return False


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="millrace-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and survives executors."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
