"""The package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application, unless they find it by PYTHONPATH or
    the working folder."""
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in known or app in _SENT:
        return
    path = Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.glob("lattica/**/*.py")):
            z.write(f, f.relative_to(ROOT))
        for f in ROOT.glob("corpus_pipeline.py"):
            z.write(f, f.name)
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
