"""Make this package importable in Python workers wherever the session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per session, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_panelcraft_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="panelcraft-package-"), "panelcraft.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._panelcraft_shipped = True
