"""Make this package importable in Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application; Spark's file server hands them out."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root, data = Path(__file__).parent, io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="snapfold-"), "snapfold.zip")
        Path(path).write_bytes(data.getvalue())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
