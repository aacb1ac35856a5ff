"""The package for the executors: one zip, which Spark hands to every worker of the session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_NAME = "transcript_jobs.zip"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run; done once for each Spark context."""
    if any(f.endswith("/" + _NAME) for f in spark.sparkContext.listFiles):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), _NAME)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    own = os.path.join(folder, name)
                    z.write(own, os.path.relpath(own, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
