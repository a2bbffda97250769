"""This package for Python workers on other machines: zipped once a session and handed out by Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Add the package to the files of the job, so that workers import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_waymark_shipped", False):
        return
    root, name = os.path.split(_PACKAGE)
    handle, path = tempfile.mkstemp(prefix=f"{name}-", suffix=".zip")  # read by the driver's own file server alone
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._waymark_shipped = True
