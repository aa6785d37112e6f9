"""The package's code for the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_shipped: set[str] = set()
_sent: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands the package's modules to the session's executors, once per application.

    Spark's own file server carries the archive, which is written on the driver; nothing is read
    back from its place. Workers that can import the package anyway lose nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lumenry-")) / "lumenry_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def ship_file(spark: SparkSession, path: str) -> str:
    """Hands a file of the driver to the session's executors, once per application; the name under which shipped_file finds it."""
    context = spark.sparkContext
    if (context.applicationId, path) not in _sent:
        context.addFile(path)
        _sent.add((context.applicationId, path))
    return Path(path).name


def shipped_file(name: str) -> str:
    """Where a shipped file lies on this machine."""
    return SparkFiles.get(name)
