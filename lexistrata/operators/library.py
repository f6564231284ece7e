"""The researcher's library: collections, their items, saved searches.

Tables are DataFrames: ``collections (id, name, description, color)``, ``items
(collection_id, corpus, id, note, tags, position)``, ``searches (id, name,
corpus, query, collection_id)``. Each change gives a new table to be written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing(collections: DataFrame, items: DataFrame, corpus: str | None = None) -> DataFrame:
    """Collections with their items in a corpus and in all; without any in the corpus only empty ones show."""
    here = F.lit(True) if corpus is None else F.col("corpus") == corpus
    counts = items.groupBy(F.col("collection_id").alias("id")).agg(F.count_if(here).alias("n_items"), F.count("*").alias("n_total"))
    out = collections.join(counts, "id", "left").fillna(0, ["n_items", "n_total"])
    return out.filter((F.col("n_items") > 0) | (F.col("n_total") == 0))


def create(collections: DataFrame, name: str, description: str = "", color: str = "") -> DataFrame:
    """One more collection; ids grow and names must be new."""
    if not name.strip():
        raise ValueError("a collection needs a name")
    if not collections.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"there is a collection {name} already")
    new = collections.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit(description).alias("description"), F.lit(color).alias("color"))
    return collections.unionByName(new)


def update(collections: DataFrame, collection_id: int, **values: str) -> DataFrame:
    it = F.col("id") == collection_id
    return collections.withColumns({k: F.when(it, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete(collections: DataFrame, items: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    return collections.filter(F.col("id") != collection_id), items.filter(F.col("collection_id") != collection_id)


def add_items(items: DataFrame, collection_id: int, corpus: str, ids: DataFrame) -> DataFrame:
    """Adds ids (id, k: requested order). Known and repeated ones are ignored; positions count every request."""
    own = items.filter((F.col("collection_id") == collection_id) & (F.col("corpus") == corpus))
    top = items.filter(F.col("collection_id") == collection_id).agg(F.coalesce(F.max("position"), F.lit(-1)).alias("top"))
    first = ids.groupBy("id").agg(F.min("k").alias("k"))
    new = first.join(own.select("id"), "id", "left_anti").crossJoin(F.broadcast(top))  # one row
    new = new.select(F.lit(collection_id).cast(items.schema["collection_id"].dataType).alias("collection_id"), F.lit(corpus).alias("corpus"), "id", F.lit("").alias("note"), F.array().cast("array<string>").alias("tags"), (F.col("top") + 1 + F.col("k")).cast(items.schema["position"].dataType).alias("position"))
    return items.unionByName(new)


def remove_items(items: DataFrame, collection_id: int, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(collection_id).alias("collection_id"))
    return items.join(gone, ["collection_id", "id"], "left_anti")


def annotate(items: DataFrame, collection_id: int, item: int, note: str | None = None, tags: list[str] | None = None) -> DataFrame:
    it = (F.col("collection_id") == collection_id) & (F.col("id") == item)
    out = items if note is None else items.withColumn("note", F.when(it, F.lit(note)).otherwise(F.col("note")))
    return out if tags is None else out.withColumn("tags", F.when(it, F.array(*map(F.lit, tags)).cast("array<string>")).otherwise(F.col("tags")))


def notes_summary(items: DataFrame, collection_id: int, first: int = 100) -> DataFrame:
    """Notes and tags of the first items by position, grouped."""
    rows = items.filter(F.col("collection_id") == collection_id).orderBy("position", "id").limit(first)
    return rows.groupBy("note", "tags").agg(F.count("*").alias("n"))


def live_searches(searches: DataFrame, collections: DataFrame) -> DataFrame:
    """Saved searches with whether the collection that they filter by is there."""
    known = collections.select(F.col("id").alias("collection_id"), F.lit(True).alias("live"))
    return searches.join(known, "collection_id", "left").withColumn("live", F.col("collection_id").isNull() | F.coalesce("live", F.lit(False)))


def restore(backup: DataFrame, collections: DataFrame) -> DataFrame:
    """(old_id, new_id): ids that a backup's collections get behind the ones that are there."""
    top = collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    order = Window.partitionBy(F.lit(0)).orderBy("id")  # a library is small
    return backup.select(F.col("id").alias("old_id"), F.row_number().over(order).alias("k")).crossJoin(F.broadcast(top)).select("old_id", (F.col("top") + F.col("k")).alias("new_id"))
