"""The code of this package for Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, for clusters that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_swarf_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="swarf-")) / "swarf.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "swarf").rglob("*.py"):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    context._swarf_shipped = True
