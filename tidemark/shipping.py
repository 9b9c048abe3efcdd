"""Sends this package to the executors, so that they need no installed copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session: a zip of the package's sources, served to executors by the driver as they come."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tidemark.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(here):
                for name in sorted(files):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("tidemark", os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(path)
    _sent.add(app)
