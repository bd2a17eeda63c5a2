"""Making this package known to Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def _on_path(folder: str) -> bool:
    """Whether workers find the folder by PYTHONPATH, which they inherit."""
    real = os.path.realpath(folder)
    return any(os.path.realpath(p) == real for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's files, once per application, unless PYTHONPATH names its folder.

    The archive is only what the driver serves to executors; it holds code, no data.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or _on_path(os.path.dirname(ROOT)):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="palaver-code-"), "palaver-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(ROOT):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("palaver", os.path.relpath(full, ROOT)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
