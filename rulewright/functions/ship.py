"""This package on the executors, for functions that run in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, those that start later too; once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    path = os.path.join(tempfile.mkdtemp(), f"{name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for file in names:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path
