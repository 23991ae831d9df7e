"""Python source of a pipeline, for those who would rather read than interpret a spec."""

from __future__ import annotations

import pprint
from collections.abc import Mapping
from typing import Any

from millrace.plans.spec import PipelineSpec
from millrace.types import Table, create_table


def pipeline_source(config: Mapping[str, Any]) -> str:
    """A script that runs the spec, and no more."""
    PipelineSpec.of(config)
    body = pprint.pformat(dict(config), width=100, sort_dicts=False)
    return f'"""Generated pipeline {config["pipeline_id"]}."""\n\nfrom pyspark.sql import SparkSession\n\nfrom millrace.runners import run\n\nSPEC = {body}\n\nif __name__ == "__main__":\n    spark = SparkSession.builder.appName(SPEC["pipeline_id"]).getOrCreate()\n    print(run(spark, SPEC))\n    spark.stop()\n'


def spec_of_table(table: Table, url: str, target: str, dialect: str = "postgresql") -> dict[str, Any]:
    """A batch pipeline that copies a database table into a versioned table: an upsert by the primary
    key if there is one, the latest row of a key by its update time, else an overwrite."""
    latest = next((c.name for c in table.columns if c.name.lower() == "updated_at"), None)
    steps = [{"type": "deduplicate", "keys": table.primary_keys, "keep": "latest_timestamp" if latest else "first"} | ({"timestamp": latest} if latest else {})] if table.primary_keys else []
    mode = {"mode": "merge", "merge_keys": table.primary_keys} if table.primary_keys else {"mode": "overwrite"}
    return {"pipeline_id": f"{table.name}_copy", "source": {"type": "jdbc", "url": url, "table": table.name}, "target": {"type": "table", "path": f"{target.rstrip('/')}/{table.name}"} | mode, "transforms": steps}


def bundle(schema: Mapping[str, Any], config: Mapping[str, Any]) -> dict[str, Any]:
    return {"schema": dict(schema), "config": dict(config)}


def table_ddl(table: Table, location: str | None = None, dialect: str = "postgresql") -> str:
    return create_table(table, location, dialect)
