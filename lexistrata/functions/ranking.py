"""Global numbering without a single task, and cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = 33


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver ends; a local one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexistrata-shared-")
    uri = f"{base.rstrip('/')}/lexistrata-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{uri}/{label}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints to the folder in ``spark.checkpoint.dir``; sets one of its own only where that is unset and all runs on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def written(*parts: DataFrame, codec: str = "snappy") -> DataFrame:
    """Written to the shared folder, one part after another, and read again. Like ``cut``, but the new plan knows nothing of the old one, whose inferred constraints grow from step to step of a long loop."""
    spark = parts[0].sparkSession
    path = shared_folder(spark, "step")
    for df in parts:
        df.write.mode("append").option("compression", codec).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, and not when the driver collects its plan. For queries whose result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Adds consecutive numbers in a global order.

    Rows are range-partitioned and sorted, and kept as dealt; one count for each
    partition, a bounded list, gives the numbers before it.
    """
    at = _free("at", df)
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    return _number(dealt, at, name, first)


def _free(name: str, df: DataFrame) -> str:
    """A column name that the table hasn't."""
    while name in df.columns:
        name = f"_{name}"
    return name


def _number(dealt: DataFrame, at: str, name: str, first: int) -> DataFrame:
    part, ahead = _free("part", dealt), _free("ahead", dealt)
    number = F.shiftright(F.col(at), _ROW_BITS)
    counts = sorted((r.p, r.n) for r in dealt.groupBy(number.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], first
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = dealt.sparkSession.createDataFrame(before, f"`{part}` long, `{ahead}` long")
    out = dealt.withColumn(part, number).join(F.broadcast(offsets), part)
    return out.withColumn(name, F.col(ahead) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop(*{part, ahead, at} - {name})
