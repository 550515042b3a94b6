"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Rows and bytes of an Arrow batch, where the session keeps Spark's defaults (10 000 and 64 MB):
#: a batch is held by the executor and again by its Python worker, so both stay small with long texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> SparkSession:
    """Give the package's sources to all executors, once for an application.

    The archive is served by the driver, so executors need no shared disk for it. Where
    the workers can import the package anyway (PYTHONPATH), it does no harm.
    """
    app = spark.sparkContext.applicationId
    if app not in _DONE:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="folioframe-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _DONE.add(app)
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return spark
