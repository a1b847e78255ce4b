"""Makes this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def to_workers(spark: SparkSession) -> None:
    """Once an application, and only if neither PYTHONPATH nor the working folder leads workers here: the sources go to the executors
    as an archive, by the driver's file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in known or Path.cwd().resolve() == _ROOT:
        return
    import tempfile

    archive = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_ROOT.glob("lodestrata/**/*.py")):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(str(archive))
