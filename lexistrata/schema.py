"""The corpus table: its columns, and adapters that make it from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import year_of
from .functions.text import word_count
from .session import ship

#: Columns of the input CSV, in order; the header is checked against them.
CSV_COLUMNS = ("id_session", "id_int", "legislature", "legislative_session", "session_number", "date", "session_type", "intervention_order", "speaker_raw", "id_dep", "speaker_name", "sex", "party", "district", "dm_speech", "text")
#: Stands for a missing value of a dimension.
UNKNOWN = "Sin identificar"

CORPUS = T.StructType(
    [
        T.StructField(n, t())
        for n, t in (
            ("id", T.LongType), ("id_int", T.StringType), ("id_session", T.StringType), ("num_session", T.IntegerType), ("session_number", T.StringType),
            ("ord", T.IntegerType), ("date", T.StringType), ("year", T.IntegerType), ("legislature", T.StringType), ("legislative_session", T.StringType),
            ("session_type", T.StringType), ("speaker", T.StringType), ("rep_id", T.IntegerType), ("id_dep", T.StringType), ("rep_name", T.StringType),
            ("sex", T.StringType), ("district", T.StringType), ("party", T.StringType), ("dm_speech", T.IntegerType), ("nwords", T.IntegerType),
            ("nbytes", T.IntegerType), ("speech", T.StringType),
        )
    ]
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also sends the package to the executors, which run its functions."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_from_documents(docs: DataFrame) -> DataFrame:
    """Documents as speeches: eight to a session, a session a week, 97 speakers.

    Everything derives from doc_id, so that SQL can say the same.
    """
    i = F.col("doc_id")
    session = F.floor(i / 8).cast("int")
    rep = (i % 97).cast("int")
    date = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (session * 7 % 4000).cast("int")), "yyyy-MM-dd")
    out = docs.select(
        i.cast("long").alias("id"), i.cast("string").alias("id_int"), F.concat(F.lit("ES"), session.cast("string")).alias("id_session"), session.alias("num_session"),
        session.cast("string").alias("session_number"), (i % 8).cast("int").alias("ord"), date.alias("date"), F.col("lang").alias("legislature"), F.lit("1").alias("legislative_session"),
        F.when(session % 5 == 0, "EXTRA").otherwise("ORD").alias("session_type"), F.concat(F.lit("SPEAKER "), rep.cast("string")).alias("speaker"), rep.alias("rep_id"),
        F.concat(F.lit("d"), rep.cast("string")).alias("id_dep"), F.concat(F.lit("rep"), rep.cast("string")).alias("rep_name"), F.when(rep % 3 == 0, "F").otherwise("M").alias("sex"),
        F.concat(F.lit("D"), (i % 7).cast("string")).alias("district"), F.col("source").alias("party"), F.when(i % 11 == 0, 0).otherwise(1).alias("dm_speech"),
        word_count(F.col("text")).alias("nwords"), F.octet_length("text").alias("nbytes"), F.col("text").alias("speech"),
    )
    return out.withColumn("year", year_of(F.col("date"))).select(*CORPUS.fieldNames())


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus table. Files of fewer splits than there are cores are dealt out by id, as text work would wait for few of them."""
    docs = read(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "doc_id")
    return corpus_from_documents(docs)


def collection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) of the labelled documents of good quality, used as a collection."""
    return read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
