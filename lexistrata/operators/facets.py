"""Facets and totals of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def facet(corpus: DataFrame, column: str) -> DataFrame:
    """(value, n, words) by n descending, then value."""
    return corpus.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.sum("nwords").alias("words")).orderBy(F.col("n").desc(), "value")


def facet_dates(corpus: DataFrame, column: str) -> DataFrame:
    """Facet with the extent in dates and the number of sessions."""
    return corpus.groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n"), F.sum("nwords").alias("words"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.countDistinct("num_session").alias("sessions")
    )


def speakers(corpus: DataFrame) -> DataFrame:
    """Speakers with their most frequent party and sex; ties go to the smaller value."""
    base = corpus.groupBy("rep_name").agg(F.count("*").alias("n"), F.sum("nwords").alias("words"))
    for column in ("party", "sex"):
        counted = corpus.groupBy("rep_name", column).agg(F.count("*").alias("c"))
        best = Window.partitionBy("rep_name").orderBy(F.col("c").desc(), column)
        top = counted.withColumn("k", F.row_number().over(best)).filter("k = 1").select("rep_name", column)
        base = base.join(top, "rep_name", "left")
    return base


def totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count("*").alias("n"), F.sum("nwords").alias("words"), F.count_if(F.col("dm_speech") == 1).alias("speeches"), F.countDistinct("num_session").alias("sessions"),
        F.countDistinct("rep_id").alias("reps"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
    )


def years(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("year").agg(F.count("*").alias("n"), F.sum("nwords").alias("words"))


def label_equivalences(corpus: DataFrame, raw: str, canonical: str) -> DataFrame:
    """For each canonical value its raw labels as (label, n), commonest first."""
    counted = corpus.groupBy(canonical, raw).agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(raw).alias("label"), F.col("n").alias("n"))))
    return counted.groupBy(canonical).agg(F.transform(order, lambda x: F.concat_ws(":", x["label"], x["n"])).alias("labels"), F.sum("n").alias("n"))
