"""Session builder with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "lexistrata", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_lexistrata_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexistrata-"), "lexistrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(package)))
    sc.addPyFile(path)
    sc._lexistrata_shipped = True
