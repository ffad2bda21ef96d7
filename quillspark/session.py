"""Makes the package known to the executors."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors once for each context, so
    that a driver may be started from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name, p.relative_to(root))))
    with tempfile.NamedTemporaryFile(prefix="quillspark-", suffix=".zip", delete=False) as f:
        f.write(data.getvalue())
    atexit.register(lambda: os.path.exists(f.name) and os.unlink(f.name))  # executors fetch it until then
    sc.addPyFile(f.name)
    sc._quillspark_shipped = True
