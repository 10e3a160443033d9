"""Makes this package importable in Spark's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers of this application, once: the driver's PYTHONPATH says nothing about theirs."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="parley-")) / "parley.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
