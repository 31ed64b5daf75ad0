"""Sends this package to the Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let functions of this package run in workers that have no copy of it: as a zip file that Spark hands to every executor, once an application."""
    application = spark.sparkContext.applicationId
    if application in _SENT:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "panelcast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_HERE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("panelcast", os.path.relpath(full, _HERE)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(application)
