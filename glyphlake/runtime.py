"""Making the package importable on executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_glyphlake_shipped"


def ship(spark: SparkSession | None) -> None:
    """Send the package through Spark's own file server, once in a session: executors need no shared folder and no installation."""
    if spark is None or getattr(spark.sparkContext, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="glyphlake-"), "glyphlake_code.zip")
    Path(path).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    setattr(spark.sparkContext, _SHIPPED, True)
