"""Getting this package to Python workers that were not started where it can be imported."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch: rows hold whole texts here, and a batch of Spark's default of 10,000 takes some 30 MB on either side of each worker.
BATCH_ROWS, DEFAULT_ROWS, BATCH_KEY = 1000, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the application's executors, once, and sets the session's Arrow batches to BATCH_ROWS rows unless another number than
    Spark's default was chosen; returns the session."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == DEFAULT_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="docloom-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
