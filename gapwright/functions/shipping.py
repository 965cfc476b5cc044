"""Makes this package importable in Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once per Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="gapwright-code-")
    target = os.path.join(folder, "gapwright_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(_PACKAGE.rglob("*.py")):
            out.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
