"""Increments: rows beyond a watermark, merged by key; deletions by an operation column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.counts import counted
from millrace.operators.dedup import deduplicate
from millrace.plans.spec import PipelineSpec
from millrace.runners.base import Runner, State
from millrace.sources import read
from millrace.streaming.ops import transform
from millrace.tables.store import TableStore


def beyond(df: DataFrame, column: str, watermark: str | None, inclusive: bool = False) -> DataFrame:
    """Rows beyond the watermark, compared in the column's own type; files and databases get the
    comparison as a filter of theirs. Inclusive reads equal rows again, for a merge to level out."""
    if watermark is None:
        return df
    limit = F.lit(watermark).cast(df.schema[column].dataType)
    return df.filter(F.col(column) >= limit if inclusive else F.col(column) > limit)


def merge_changes(store: TableStore, changes: DataFrame, keys: Sequence[str], op_column: str | None = None, delete_value: str = "D", soft_delete: bool = False, order: str | None = None, transaction: tuple[str, int] | None = None) -> int:
    """Merges changes by key, of several for a key the latest by order. A row whose operation is the
    delete value removes the row, or with soft_delete only marks it in _is_deleted; a null operation
    is an upsert. Soft-deleted rows that the table never had come in marked."""
    if order:
        changes = deduplicate(changes, keys, "latest_timestamp", timestamp=order, ties=[c for c in changes.columns if c not in (*keys, order)][:3])
    if not op_column:
        return store.merge(changes, keys, transaction=transaction)
    deleted = F.col(op_column).eqNullSafe(delete_value)
    rest = [c for c in changes.columns if c != op_column]
    if soft_delete:
        marked = changes.withColumn("_is_deleted", deleted).select(*rest, "_is_deleted")
        if not store.exists():
            return store.write(marked, "overwrite", transaction=transaction)
        have = store.read().columns
        sets = {c: f"CASE WHEN source._is_deleted THEN target.`{c}` ELSE source.`{c}` END" if c in have else f"source.`{c}`" for c in rest}
        return store.merge(marked, keys, update_set=sets | {"_is_deleted": "source._is_deleted"}, transaction=transaction)
    flagged = changes.withColumn("_op_delete", deleted).select(*rest, "_op_delete")
    if not store.exists():
        return store.write(flagged.filter("NOT _op_delete").select(*rest), "overwrite", transaction=transaction)
    plain = {c: f"source.`{c}`" for c in rest}
    return store.merge(flagged, keys, update_set=plain, insert_values=plain, insert_condition="NOT source._op_delete", delete_condition="source._op_delete", transaction=transaction, hidden=("_op_delete",))


class IncrementalRunner(Runner):
    """spec.incremental: watermark_column, keys, inclusive, op_column, delete_value, soft_delete,
    order. The watermark comes from the state, else from the table, and is saved after the merge; it is
    the greatest of the raw increment, and never null."""

    def _run(self, spec: PipelineSpec) -> dict[str, Any]:
        inc = spec.incremental
        column, keys = inc["watermark_column"], inc["keys"]
        store, state = TableStore(self.spark, spec.target["path"]), State(self.spark, spec.state_path, spec.pipeline_id)
        last = state.load().get("watermark")
        if last is None and store.exists() and column in (have := store.read()).columns:
            found = have.agg(F.max(column).cast("string")).first()[0]
            last = found
        seen = Observation()
        raw = beyond(read(self.spark, spec.source), column, last, inc.get("inclusive", False))
        ends = [F.count(F.lit(1)).alias("n"), F.max(column).cast("string").alias("top")]
        changes = transform(raw.observe(seen, *ends), spec.transforms).persist()
        try:
            n, found = changes.count(), counted(seen, raw, *ends)
            if found["n"] == 0:
                return {"rows": 0, "watermark": last}
            merge_changes(store, changes, keys, inc.get("op_column"), inc.get("delete_value", "D"), inc.get("soft_delete", False), inc.get("order", column))
        finally:
            changes.unpersist()
        top = found["top"]
        if top is not None:
            state.save(watermark=top)
        return {"rows": n, "watermark": top if top is not None else last}
