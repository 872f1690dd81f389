"""Giving Python workers this package, wherever the driver has it from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="promptloom-pkg-")
        atexit.register(shutil.rmtree, folder, True)
        shutil.copytree(package, f"{folder}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}-workers", "zip", f"{folder}/tree"))
        _sent.add(app)
