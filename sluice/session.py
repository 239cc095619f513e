"""Sessions: settings the engine expects, and the package on the executors' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "sluice", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once an application; on one machine they have it."""
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parent
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    on_one_machine = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if app not in _shipped and not on_one_machine and str(root.parent) not in on_path:
        fd, name = tempfile.mkstemp(prefix="sluice-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
    _shipped.add(app)
    return spark
