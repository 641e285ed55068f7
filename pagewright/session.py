"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package's modules to all Python workers of the session, once; Spark serves the archive to executors."""
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "pagewright_modules.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(ROOT, "pagewright")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._pagewright_shipped = True
