"""Versioned tables on Parquet: immutable data files, and a manifest file for each version.

A version names the folders and files that make it up. A merge, a replacement and a deletion write anew
only the files that hold a row in question; the others are named again. A commit gives a manifest that
is whole the name of the next number, which fails if another writer has been first, so writers cannot
overwrite each other and readers never meet half a manifest; an append then tries the next number,
anything else is an error. Everything goes through Spark and Hadoop's file systems, so a table can lie
wherever Spark can write and a rename can be refused (see millrace.storage).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.counts import counted
from millrace.operators.joins import key_condition
from millrace.storage import read_text, write_text


class ConflictError(RuntimeError):
    """Another writer committed first."""


class TableStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _log(self, version: int) -> str:
        return f"{self.path}/_manifest/{version:020d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None, timestamp: str | datetime | None = None) -> dict:
        """Of a version, else of the last one at a time (UTC if it names no zone), else of the last."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        if version is not None:
            if version not in known:
                raise ValueError(f"no version {version}; there are {known[0]} to {known[-1]}")
            return self._load(version)
        if timestamp is None:
            return self._load(known[-1])
        at = datetime.fromisoformat(timestamp) if isinstance(timestamp, str) else timestamp
        limit = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()
        for v in reversed(known):
            if (found := self._load(v))["time"] <= limit:
                return found
        raise ValueError(f"no version as early as {timestamp}")

    def _load(self, version: int) -> dict:
        return json.loads(read_text(self.spark, self._log(version)))

    def _commit(self, entry: dict, retry: bool = False) -> int:
        while True:
            version = (self.versions() or [-1])[-1] + 1
            if version != entry["base"] + 1 and not retry:
                raise ConflictError(f"version {version - 1} came in between")
            if version != entry["base"] + 1:  # an append goes on top of what came in between
                now = self._load(version - 1)
                entry = entry | {"base": version - 1, "parts": now["parts"] + entry["added"], "rows": now["rows"] + entry["metrics"]["written"]}
            if write_text(self.spark, self._log(version), json.dumps(entry | {"version": version, "time": time.time()}), overwrite=False):
                return version
            if not retry:
                raise ConflictError(f"version {version} came in between")

    # reading

    def read(self, version: int | None = None, timestamp: str | datetime | None = None) -> DataFrame:
        """A version, which counts before a timestamp; else the last."""
        return self._frame(self.manifest(version, timestamp))

    def _frame(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if not entry["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{p}" for p in entry["parts"]]).select(*[F.col(f"`{f.name}`") for f in schema])

    def detail(self) -> dict:
        entry = self.manifest()
        sizes = [self._fs.getContentSummary(self._path(f"{self.path}/{p}")) for p in entry["parts"]]
        return {
            "version": entry["version"],
            "timestamp": datetime.fromtimestamp(entry["time"], timezone.utc),
            "numFiles": len(self._files(*entry["parts"])),
            "sizeInBytes": sum(s.getLength() for s in sizes),
            "partitionColumns": entry["partition_by"],
            "numRows": entry["rows"],
        }

    def _files(self, *parts: str) -> list[str]:
        """The data files of folders and files of a version. Spark lists them, many folders at a time by a
        job, and the names come over in one piece."""
        there = [p for p in parts if p.endswith(".parquet") or self._fs.exists(self._path(f"{self.path}/{p}"))]
        found = [p for p in there if p.endswith(".parquet")]
        if folders := [f"{self.path}/{p}" for p in there if not p.endswith(".parquet")]:
            listed = self.spark.read.schema("_ int").option("recursiveFileLookup", True).parquet(*folders)._jdf.inputFiles()
            names = self.spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", listed)
            found += ["data/part=" + unquote(n.partition("/data/part=")[2]) for n in names.split("\n") if n]
        return found

    def history(self, limit: int = 20) -> DataFrame:
        """The last versions, newest first."""
        rows = [(e["version"], datetime.fromtimestamp(e["time"], timezone.utc), e["operation"], e["rows"], json.dumps(e["metrics"])) for e in map(self._load, self.versions()[-limit:][::-1])]
        return self.spark.createDataFrame(rows, "version long, timestamp timestamp, operation string, rows long, metrics string").orderBy(F.desc("version"))

    # writing

    def _write(self, df: DataFrame, partition_by: Sequence[str], options: Mapping[str, Any] | None = None) -> tuple[str, int]:
        """Writes a new folder and counts its rows in the same job."""
        name, seen = f"data/part={uuid.uuid4().hex}", Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**(options or {}))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{name}")
        return name, seen.get["n"]

    def _entry(self, base: dict | None, operation: str, schema: StructType, partition_by: Sequence[str], parts: list[str], rows: int, **more: Any) -> dict:
        nullable = StructType.fromJson(json.loads(schema.json()))
        for f in nullable:
            f.nullable = True
        return {"base": base["version"] if base else -1, "operation": operation, "schema": nullable.jsonValue(), "partition_by": list(partition_by), "parts": parts, "rows": rows, "metrics": {}, "added": [], "transactions": (base or {}).get("transactions", {})} | more

    def write(self, df: DataFrame, mode: str = "append", partition_by: Sequence[str] = (), merge_schema: bool = False, transaction: tuple[str, int] | None = None, options: Mapping[str, Any] | None = None) -> int:
        """append, overwrite, error or ignore; returns the version. transaction (query, batch) makes a
        repeat of a batch that was committed do nothing."""
        base = self.manifest() if self.exists() else None
        if transaction and base and base["transactions"].get(transaction[0], -1) >= transaction[1]:
            return base["version"]
        if base and mode == "ignore":
            return base["version"]
        if base and mode in ("error", "errorifexists"):
            raise FileExistsError(self.path)
        if mode not in ("append", "overwrite", "error", "errorifexists", "ignore"):
            raise ValueError(f"unknown mode {mode!r}")
        schema, partition_by = df.schema, list(partition_by) or (base["partition_by"] if base else [])
        if base and mode == "append":
            schema = self._appendable(StructType.fromJson(base["schema"]), df, merge_schema)
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])
        name, n = self._write(df, partition_by, options)
        before = base["parts"] if base and mode == "append" else []
        rows = n + (base["rows"] if base and mode == "append" else 0)
        more = {"metrics": {"written": n}, "added": [name]}
        if transaction:
            more["transactions"] = ((base or {}).get("transactions", {})) | {transaction[0]: transaction[1]}
        return self._commit(self._entry(base, mode, schema, partition_by, [*before, name], rows, **more), retry=mode == "append" and not transaction)

    @staticmethod
    def _appendable(have: StructType, df: DataFrame, merge: bool) -> StructType:
        new = [f for f in df.schema if f.name not in have.fieldNames()]
        if new and not merge:
            raise ValueError(f"columns that the table has not: {[f.name for f in new]}")
        for f in df.schema:
            if f.name in have.fieldNames() and have[f.name].dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name}: the table has {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        return StructType([*have.fields, *new])

    def _rewrite(self, df: DataFrame, base: dict, operation: str, metrics: Mapping[str, Any] = {}, transaction: tuple[str, int] | None = None, schema: StructType | None = None) -> int:
        name, n = self._write(df, base["partition_by"])
        more: dict[str, Any] = {"metrics": dict(metrics) | {"written": n}}
        if transaction:
            more["transactions"] = base["transactions"] | {transaction[0]: transaction[1]}
        return self._commit(self._entry(base, operation, schema or df.schema, base["partition_by"], [name], n, **more))

    def merge(
        self,
        source: DataFrame,
        keys: Sequence[str],
        update_condition: str | None = None,
        update_set: Mapping[str, str] | None = None,
        insert_condition: str | None = None,
        insert_values: Mapping[str, str] | None = None,
        delete_condition: str | None = None,
        check_keys: bool = True,
        transaction: tuple[str, int] | None = None,
        hidden: Sequence[str] = (),
    ) -> int:
        """Upserts by keys, in one pass over both sides; a table that is not there is created.

        Conditions and expressions say target. and source. . A matched row goes if delete_condition
        holds, else takes update_set (all source columns without one) if update_condition holds, else
        stays. Others come in if insert_condition holds. Null keys match nothing. A key that the source
        has twice is an error. Columns of the source alone are added,
        but for hidden ones, which only the conditions see."""
        if check_keys:
            twice = source.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"the source has a key twice: {twice[0].asDict()}")
        if not self.exists():
            fresh = source.alias("source")
            if insert_condition:
                fresh = fresh.filter(insert_condition)
            return self.write(fresh.select("source.*"), "overwrite", transaction=transaction)
        base = self.manifest()
        if transaction and base["transactions"].get(transaction[0], -1) >= transaction[1]:
            return base["version"]
        have = StructType.fromJson(base["schema"])
        added = [f for f in source.schema if f.name not in have.fieldNames() and f.name not in hidden]
        schema = StructType([*have.fields, *added])
        touched = self._touched(base, source, keys)
        within = base if touched is None else base | {"parts": touched}
        before = Observation()
        target = self._frame(within).observe(before, F.count(F.lit(1)).alias("n")).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
        both = target.withColumn("_in", F.lit(True)).alias("target").join(source.withColumn("_in", F.lit(True)).alias("source"), key_condition("target", "source", keys), "full_outer")
        in_target, in_source = F.col("target._in").isNotNull(), F.col("source._in").isNotNull()
        matched = in_target & in_source
        holds = lambda condition: F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
        deleted = matched & holds(delete_condition) if delete_condition else F.lit(False)
        updated = matched & holds(update_condition)
        kept = (in_target & ~deleted) | (~in_target & holds(insert_condition))

        def value(name: str) -> Column:
            own, theirs = F.col(f"target.`{name}`"), F.col(f"source.`{name}`") if name in source.columns else None
            set_to = F.expr(update_set[name]) if update_set and name in update_set else own if update_set or theirs is None else theirs
            new = F.expr(insert_values[name]) if insert_values and name in insert_values else F.lit(None) if insert_values or theirs is None else theirs
            return F.when(~in_target, new).when(updated, set_to).otherwise(own).cast(schema[name].dataType).alias(name)

        merged = both.filter(kept).select(*[value(f.name) for f in schema])
        if touched is None:
            return self._rewrite(merged, base, "merge", transaction=transaction, schema=schema)
        name, n = self._write(merged, base["partition_by"])
        gone = counted(before, self._frame(within), F.count(F.lit(1)).alias("n"))["n"] if touched else 0
        more: dict[str, Any] = {"metrics": {"written": n, "files_rewritten": len(touched)}}
        if transaction:
            more["transactions"] = base["transactions"] | {transaction[0]: transaction[1]}
        return self._commit(self._entry(base, "merge", schema, base["partition_by"], [*self._without(base, touched), name], base["rows"] - gone + n, **more))

    def _without(self, base: dict, files: Sequence[str]) -> list[str]:
        """The parts of a version without some files; folders that hold none of them stay folders."""
        gone, within = set(files), {"/".join(f.split("/")[:2]) for f in files}
        opened = [p for p in base["parts"] if p in within]
        rest = [f for f in self._files(*opened) if f not in gone] if opened else []
        return [p for p in base["parts"] if p not in within and p not in gone] + rest

    def _touched(self, base: dict, source: DataFrame, keys: Sequence[str]) -> list[str] | None:
        """The files with a key of the source; None if that is so many that the whole table may as well
        be written anew."""
        files = self._files(*base["parts"])
        if len(files) < 4:
            return None
        rows = self._named(base).select(*[F.col(f"`{k}`") for k in keys], "_file")
        found = self._holding(rows.join(source.select(*[F.col(f"`{k}`") for k in keys]), list(keys), "left_semi"))
        return None if len(found) * 2 > len(files) else found

    def _named(self, base: dict) -> DataFrame:
        """The rows of a version, with the names of their files as _file."""
        schema = StructType.fromJson(base["schema"])
        named = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{p}" for p in base["parts"]])
        return named.select(*[F.col(f"`{f.name}`") for f in schema], F.col("_metadata.file_path").alias("_file"))

    @staticmethod
    def _holding(rows: DataFrame) -> list[str]:
        """The files that rows come from."""
        return ["data/part=" + unquote(r["_file"].partition("/data/part=")[2]) for r in rows.select("_file").distinct().collect()]

    def _remove(self, condition: str, operation: str, fresh: DataFrame | None = None) -> int:
        """Removes the rows that meet the condition and adds fresh ones. Only files with such rows are
        written anew; filters on partitions and column statistics spare the scan of most others."""
        base = self.manifest()
        meets = F.coalesce(F.expr(condition), F.lit(False))
        touched = self._holding(self._named(base).filter(F.expr(condition))) if base["parts"] else []
        schema = StructType.fromJson(base["schema"])
        before = Observation()
        within = self._frame(base | {"parts": touched})
        target = within.observe(before, F.count(F.lit(1)).alias("n"))
        kept = target.filter(~meets)
        made = kept if fresh is None else kept.unionByName(fresh.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]))
        name, n = self._write(made, base["partition_by"])
        gone = counted(before, within, F.count(F.lit(1)).alias("n"))["n"] if touched else 0
        more = {"metrics": {"written": n, "files_rewritten": len(touched)}}
        return self._commit(self._entry(base, operation, schema, base["partition_by"], [*self._without(base, touched), name], base["rows"] - gone + n, **more))

    def replace_where(self, df: DataFrame, condition: str) -> int:
        """Replaces the rows that meet the condition; new rows that do not meet it are an error."""
        if df.filter(~F.coalesce(F.expr(condition), F.lit(False))).limit(1).count():
            raise ValueError(f"rows outside {condition}")
        return self._remove(condition, "replace", df)

    def delete_where(self, condition: str) -> int:
        return self._remove(condition, "delete")

    def restore(self, version: int) -> int:
        """A new version with the rows of an old one; no data is written."""
        base, old = self.manifest(), self.manifest(version)
        entry = self._entry(base, f"restore {version}", StructType.fromJson(old["schema"]), old["partition_by"], old["parts"], old["rows"])
        return self._commit(entry)

    def optimize(self, z_order: Sequence[str] = (), target_mb: int = 128) -> int:
        """Compacts to files of about target_mb, clustered along z_order if given: rows are dealt out by
        ranges of a key that interleaves the bits of each column's rank among its quantiles."""
        base = self.manifest()
        df, n = self._frame(base), max(1, -(-self.detail()["sizeInBytes"] // (target_mb << 20)))
        if z_order:
            df = df.withColumn("_z", _interleaved(df, z_order)).repartitionByRange(n, "_z").sortWithinPartitions("_z").drop("_z")
        else:
            df = df.repartition(n, *base["partition_by"]) if base["partition_by"] else df.coalesce(n) if n <= len(base["parts"]) else df.repartition(n)
        return self._rewrite(df, base, "optimize", {"z_order": list(z_order)})

    def vacuum(self, hours: float = 168.0) -> list[str]:
        """Deletes data files that no version of the last hours uses, manifests of older ones that did, and
        what writes that failed have left since before then. Returns the files. With hours shorter than a
        write takes, what is being written goes too."""
        known, limit = self.versions(), time.time() - hours * 3600
        entries = {v: self._load(v) for v in known}
        kept = {v for v in known if v == known[-1] or entries[v]["time"] >= limit}
        every = self._files(*{p for e in entries.values() for p in e["parts"]})
        inside: dict[str, set[str]] = {}
        for f in every:
            inside.setdefault("/".join(f.split("/")[:2]), set()).add(f)
        files = {v: {f for p in entries[v]["parts"] for f in ([p] if p.endswith(".parquet") else inside.get(p, ()))} for v in known}
        used = {f for v in kept for f in files[v]}
        gone = sorted({f for v in known for f in files[v]} - used)
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/{f}"), False)
        for v in known:
            if v not in kept and not files[v] <= used:
                self._fs.delete(self._path(self._log(v)), False)
        return gone + self._orphans({"/".join(p.split("/")[:2]) for e in entries.values() for p in e["parts"]}, limit)

    def _orphans(self, named: set[str], limit: float) -> list[str]:
        """Deletes folders of data, and manifests without a version, that no version names and that are older
        than the limit."""
        found = []
        for folder in ("data", "_manifest"):
            root = self._path(f"{self.path}/{folder}")
            for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
                name = f"{folder}/{s.getPath().getName()}"
                stray = name not in named if folder == "data" else s.getPath().getName().startswith(".") and not name.endswith(".crc")
                if stray and s.getModificationTime() / 1000 < limit:
                    self._fs.delete(s.getPath(), True)
                    found.append(name)
        return found


def _interleaved(df: DataFrame, columns: Sequence[str], bits: int = 10) -> Column:
    """The bits of the columns' ranks among 2 ** bits quantiles, the highest first in turn. Ranks come
    from approximate quantiles: one pass, and bounded arrays on the driver. Text ranks by its hash-free
    first bytes."""
    order = {c: F.col(c).cast("double") if not isinstance(df.schema[c].dataType.typeName(), str) or df.schema[c].dataType.typeName() not in ("string", "date", "timestamp", "timestamp_ntz") else F.conv(F.hex(F.rpad(F.substring(F.col(c).cast("string"), 1, 6), 6, " ")), 16, 10).cast("double") if df.schema[c].dataType.typeName() == "string" else F.unix_seconds(F.col(c).cast("timestamp")).cast("double") for c in columns}
    shares = F.array(*[F.lit(k / 2**bits) for k in range(1, 2**bits)])
    cuts = df.agg(*[F.percentile_approx(e, shares, 2000).alias(f"c{i}") for i, e in enumerate(order.values())]).first()
    key = F.lit(0).cast("long")
    ranks = [F.coalesce(F.size(F.filter(F.array(*[F.lit(float(v)) for v in sorted(set(cuts[i] or []))]), lambda v, e=e: v < e)), F.lit(0)).cast("long") for i, e in enumerate(order.values())]
    for b in range(bits - 1, -1, -1):
        for r in ranks:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(r, b).bitwiseAND(F.lit(1).cast("long")))
    return key
