"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless ``PYTHONPATH`` already leads there."""
    home = Path(__file__).resolve().parent
    application = spark.sparkContext.applicationId
    if str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or application in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in home.rglob("*.py"):
            out.write(path, str(path.relative_to(home.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)
