"""What a session needs before it runs the engine's queries."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that don't find it on PYTHONPATH; once for a context."""
    context = spark.sparkContext
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or getattr(context, "_lodestrata_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "lodestrata.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "lodestrata").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    context._lodestrata_shipped = True
