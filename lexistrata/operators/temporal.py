"""Joins over time: labels in force at a date, holders of an office, milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(rows: DataFrame, key: str, at: str, options: DataFrame, value: str, valid_from: str = "valid_from") -> DataFrame:
    """Adds ``value``: the last option of the row's key that began by ``at``, else the first one.

    The options of each key are gathered into one sorted array (a registry, small
    for each key), so the rows are joined once by key and never multiplied.
    """
    table = options.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(valid_from).alias("f"), F.col(value).alias("v")))).alias("__options"))
    begun = F.filter("__options", lambda o: o["f"].isNull() | (o["f"] <= F.col(at)))
    chosen = F.coalesce(F.try_element_at(begun, F.lit(-1))["v"], F.try_element_at("__options", F.lit(1))["v"])
    return rows.join(table, key, "left").withColumn(value, chosen).drop("__options")


def in_force(rows: DataFrame, at: Column, holders: DataFrame) -> DataFrame:
    """Rows with the holders (key, name, date_from, date_to) whose term covers the date; the end is open.

    An equi-join on the key comes first, so only the terms of one office are compared.
    """
    return rows.withColumn("__at", at).join(holders, "key").filter((F.col("date_from") <= F.col("__at")) & (F.col("date_to").isNull() | (F.col("__at") < F.col("date_to")))).drop("__at")


def normalise_party(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """Replaces ``party`` by the canonical one for its label and date; unknown labels stay."""
    out = as_of(corpus.withColumnRenamed("party", "label"), "label", "date", labels, "sigla")
    return out.withColumn("party", F.coalesce("sigla", "label")).drop("sigla")
