"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Rows and bytes of an Arrow batch at most: texts can be long, and two copies of a batch are held on either side.
_BATCH_ROWS = 1000
_BATCH_BYTES = 4 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound Arrow batches."""
    if not 0 < int(spark.conf.get(_ROWS)) <= _BATCH_ROWS:
        spark.conf.set(_ROWS, str(_BATCH_ROWS))
    if not 0 < int(str(spark.conf.get(_BYTES)).rstrip("b")) <= _BATCH_BYTES:
        spark.conf.set(_BYTES, str(_BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_lexistrata_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lexistrata-")
    path = os.path.join(folder, "lexistrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._lexistrata_shipped = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """URI of a new folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; only where that is unset and all runs on
    one machine (tests) is a local folder made. Hadoop deletes it when the driver
    ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexistrata-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    uri = f"{base.rstrip('/')}/lexistrata-{uuid.uuid4().hex}/{label}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path.getParent())
    return fs.makeQualified(path).toString()


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    uri = scratch(spark, label)
    df.write.mode("overwrite").option("compression", compression).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def file_system(uri: str):
    """Arrow file system and path for a URI, for code on the executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
