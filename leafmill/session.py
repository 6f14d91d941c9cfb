"""Sessions, and this package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "leafmill", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; everything else is the caller's or the cluster's."""
    build = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        build = build.config(k, v)
    return build.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once an application, so that Python workers can import it wherever they
    run. Where it is on their path already, that copy is the one they find."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="leafmill-code-"), "leafmill_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
