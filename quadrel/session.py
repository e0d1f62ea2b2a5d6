"""Session helpers: a local session for tests and tools, and shipping this package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a session; they need not share our folder."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / "quadrel-package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(key)
