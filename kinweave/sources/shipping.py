"""Making this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import kinweave

_NAME = "kinweave-package.zip"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT, _OURS = "67108864b", "8m"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's workers, once a session, and keep Arrow batches small.

    Batches of 64 MB, Spark's default, stand several times in the memory of each
    task and its worker; a session that sets its own size keeps it.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, _OURS)
    if _NAME in context._python_includes:
        return
    top = Path(kinweave.__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="kinweave-")), _NAME)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
