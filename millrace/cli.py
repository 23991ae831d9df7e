"""Command line: init reads a database's metadata, generate writes a script, validate checks a spec
and run runs it."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Sequence

from millrace import config
from millrace.plans.spec import PipelineSpec


def _session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write a database's metadata as YAML")
    init.add_argument("--url", required=True)
    init.add_argument("--user")
    init.add_argument("--password")
    init.add_argument("--schema")
    init.add_argument("--out", required=True)
    for name in ("generate", "run", "validate"):
        c = commands.add_parser(name)
        c.add_argument("spec")
        if name == "generate":
            c.add_argument("--out", required=True)
    given = parser.parse_args(args)
    if given.command == "init":
        from millrace.metadata import extract

        found = extract(_session("millrace init"), {"url": given.url, "user": given.user, "password": given.password}, schema=given.schema)
        config.save(dataclasses.asdict(found), given.out)
        print(f"{len(found.tables)} tables")
        return 0
    spec = config.load(given.spec)
    try:
        PipelineSpec.of(spec)
    except (TypeError, ValueError) as e:
        print(f"invalid: {e}", file=sys.stderr)
        return 1
    if given.command == "generate":
        from millrace.plans.codegen import pipeline_source

        with open(given.out, "w", encoding="utf-8") as f:
            f.write(pipeline_source(spec))
    elif given.command == "run":
        from millrace.runners import run

        print(json.dumps(run(_session(spec["pipeline_id"]), spec), default=str))
    else:
        print("valid")
    return 0


if __name__ == "__main__":
    sys.exit(main())
