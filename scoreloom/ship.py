"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package as a zip file, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_scoreloom_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="scoreloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "scoreloom_package"), "zip", os.path.dirname(here), os.path.basename(here)))
    sc._scoreloom_sent = True
