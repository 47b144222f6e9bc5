"""The package for the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the package to Python workers elsewhere, once for each context.  (The archive is code; Spark carries it.)"""
    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", False):
        return
    top = Path(__file__).resolve().parent
    if top.is_dir():
        out = Path(tempfile.mkdtemp()) / "weftgraph_pkg.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        sc.addPyFile(str(out))
    sc._weftgraph_shipped = True
