"""Sends this package to the Python workers, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import marquee

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once per application: a zip of the package goes out through Spark's own file server.

    The zip is written on the driver, read by the driver's file server and by nobody else.
    """
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        root = Path(marquee.__file__).parent
        path = Path(tempfile.mkdtemp(prefix="marquee-code-")) / "marquee_code.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, Path("marquee") / file.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        _SENT.add(app)
    return spark
