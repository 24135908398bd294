"""This package on the Python workers, wherever the driver started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; call it before any Python map."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tallymark-")) / "tallymark.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((root / "tallymark").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
