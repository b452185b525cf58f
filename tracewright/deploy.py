"""Make this package importable by the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure_on_executors(spark: SparkSession) -> None:
    """Send the package's sources along with the session's tasks, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tracewright-code-")) / "tracewright_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
