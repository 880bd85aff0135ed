"""Sends this package to Python workers that may not have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; the driver serves the archive to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="ledgerframe-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "ledgerframe_workers.zip", "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(folder / "ledgerframe_workers.zip"))
