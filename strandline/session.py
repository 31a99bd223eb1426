"""Sessions: executors get the package, so that their Python workers can import it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "strandline-package"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if not any(_NAME in p for p in context._python_includes):
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{_NAME}", "zip", root.parent, root.name)
        context.addPyFile(archive)
        # streams with state start a worker beside the driver, which takes no files but this path
        paths = [p for p in (str(root.parent), context.environment.get("PYTHONPATH")) if p]
        context.environment["PYTHONPATH"] = os.pathsep.join(paths)
    return spark
