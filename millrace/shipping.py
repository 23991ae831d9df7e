"""Gives the executors' Python workers this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's context, once. Executors get it over the
    network, whatever they have installed."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).parent
    if root.is_dir():  # not when this module itself comes out of a zip file
        target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
    context._millrace_shipped = True
