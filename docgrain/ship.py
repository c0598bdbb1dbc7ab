"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, unless PYTHONPATH already names it.

    Executors that join later, or replace lost ones, fetch it as well.
    """
    top = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(top.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="docgrain-")
    path = os.path.join(folder, "docgrain.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"docgrain/{p.relative_to(top)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
