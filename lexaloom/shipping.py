"""Makes this package importable in the Python workers, whatever their path is."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package's code along with the session's tasks, once per application."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexaloom-code-")) / "lexaloom-code.zip"  # on the driver, which serves it
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(spark.sparkContext.applicationId)
