"""The package on the executors' Python path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless their path has it already.

    Workers inherit PYTHONPATH and start in the driver's folder in local mode; a driver that found the
    package in another way has to send it.
    """
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == _ROOT for p in known):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="transitloom-"), "transitloom"), "zip", _ROOT, "transitloom")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
