"""Making this package importable in Python workers that don't find it on their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application.

    Not where workers inherit its place: the working folder or PYTHONPATH.
    """
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    seen = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if app in _SENT or any(os.path.realpath(p) == str(package.parent) for p in seen):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="trivium-"), "trivium.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(archive)
    _SENT.add(app)
