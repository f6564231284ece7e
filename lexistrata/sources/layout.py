"""Tables of a corpus laid out by session and by speaker, with statistics.

Both are bucketed and sorted by what queries group by, so windows and groups
over sessions or speakers read them as they lie, without a shuffle. The
optimiser gets statistics of the columns that queries filter and group by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: table -> (bucket column, columns of the order inside a bucket)
LAYOUTS = {"sessions": ("num_session", ("num_session", "date", "id")), "speakers": ("rep_name", ("rep_name", "party", "sex"))}
#: Columns with statistics; texts have none.
ANALYSED = ("id", "num_session", "date", "year", "legislature", "session_type", "rep_id", "rep_name", "sex", "party", "nwords")


def write_layout(corpus: DataFrame, prefix: str, bucket_bytes: int = 128 << 20, least: int = 1) -> dict[str, str]:
    """Writes ``{prefix}_sessions`` and ``{prefix}_speakers`` to the warehouse; returns table names by layout.

    The number of buckets follows from the bytes of the texts. A session or
    speaker lies in one bucket, which for the speakers' table holds no texts, so
    that a frequent speaker makes no large one. Existing tables are replaced.
    """
    spark = corpus.sparkSession
    total = corpus.agg(F.coalesce(F.sum("nbytes"), F.lit(0))).first()[0]
    names = {}
    for layout, (key, order) in LAYOUTS.items():
        # the speakers' table has some hundred bytes a row in place of the text
        rows = corpus if layout == "sessions" else corpus.drop("speech")
        buckets = max(least, -(-int(total) // bucket_bytes))
        name = names[layout] = f"{prefix}_{layout}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # one task for each bucket, so that a bucket is one file and its order holds
        rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(*order).saveAsTable(name)
        kept = [c for c in ANALYSED if c in rows.columns]
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(kept)}")
    return names


def by_session(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """The whole corpus by session."""
    return spark.table(names["sessions"])


def by_speaker(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """The corpus without texts by speaker."""
    return spark.table(names["speakers"])


def column_statistics(spark: SparkSession, table: str, column: str) -> dict[str, str]:
    """What the catalog knows of a column: least and greatest value, nulls, distinct values."""
    return {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {table} {column}").collect()}
