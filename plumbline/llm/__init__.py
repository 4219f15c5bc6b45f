"""Operators for training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="spark-plumbline-")) / "plumbline_workers.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for path in sorted([*here.glob("*.py"), here.parent / "__init__.py",
                            here.parent / "session.py"]):
            out.write(path, path.relative_to(here.parents[1]))
    sc.addPyFile(str(bundle))
    sc._plumbline_shipped = True
