"""Sends the package to the executors of a session that doesn't have it yet."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a Python file of the application, once; Spark serves it to every executor."""
    context = spark.sparkContext
    name = f"{_PACKAGE.name}.zip"
    if not any(path.endswith(f"/{name}") for path in context.listFiles):
        folder = tempfile.mkdtemp(prefix="sievegrid-")
        made = shutil.make_archive(f"{folder}/{_PACKAGE.name}", "zip", _PACKAGE.parent, _PACKAGE.name)
        context.addPyFile(made)
    return spark
