"""Making the package known to Python workers that were started without it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Applications that have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the session's Python workers, once per Spark context."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")  # kept: Spark reads it when tasks start
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
