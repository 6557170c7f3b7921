"""Makes the package importable in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="cubeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "cubeloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((_ROOT / "cubeloom").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT).as_posix())
    sc.addPyFile(str(target))
