"""Gives the executors' Python workers this package, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the application once; Spark's own file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_ships_sessionscope", False):
        return
    archive = f"{tempfile.mkdtemp(prefix='sessionscope-package-')}/{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._ships_sessionscope = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)``, after the package was handed out."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        return query(spark, *args)

    return run
