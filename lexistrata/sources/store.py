"""A library that persists: snapshots under a manifest that is put in place at once.

Tables are written to folders of their own and never changed. A manifest of one
version names the folder of each table. It becomes that version by a rename that
fails where the version is there, so of two writers one wins and the other has
to read again: no update is lost. Readers of an older manifest keep theirs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMAS = {
    "collections": "id int, name string, description string, color string",
    "items": "collection_id int, corpus string, id long, note string, tags array<string>, position int",
    "searches": "id int, name string, corpus string, query string, collection_id int",
}
FORMAT = "lexistrata-backup/1"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] = SCHEMAS):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("manifests").getFileSystem(self.conf)
        self.fs.mkdirs(self._at("manifests"))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest(self, version: int) -> str:
        return f"manifests/{version:012d}.json"

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("manifests"))]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self.fs.open(self._at(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> tuple[int, dict[str, DataFrame]]:
        """(version, tables), of the newest version or an older one that is kept; tables that no version has are empty."""
        version = self.version() if version is None else version
        folders = self._folders(version)
        tables = {}
        for name, schema in self.schemas.items():
            if name in folders:
                tables[name] = self.spark.read.schema(schema).parquet(f"{self.path}/{folders[name]}")
            else:
                tables[name] = self.spark.createDataFrame([], schema)
        return version, tables

    def commit(self, version: int, changed: dict[str, DataFrame]) -> int:
        """Writes the changed tables as the version after ``version``; raises ``Conflict`` if there is one already."""
        folders = self._folders(version)
        for name, df in changed.items():
            folders[name] = f"data/{name}-{uuid.uuid4().hex}"
            wanted = self.spark.createDataFrame([], self.schemas[name]).schema
            df.select(*(F.col(f.name).cast(f.dataType) for f in wanted)).write.parquet(f"{self.path}/{folders[name]}")
        draft = self._at(f"manifests/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(draft).toUri(), self.conf)
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self._at(self._manifest(version + 1))), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version + 1} is there") from None
            raise
        return version + 1

    def change(self, f: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 10) -> int:
        """Applies ``f`` to the newest tables and commits what it returns; reads and applies again after a conflict."""
        for k in range(tries):
            version, tables = self.read()
            try:
                return self.commit(version, f(tables))
            except Conflict:
                if k + 1 == tries:
                    raise
        raise AssertionError

    def prune(self, keep: int = 10) -> int:
        """Deletes manifests before the newest ``keep``, and data that none of those names and that is older than the oldest of them; the number of folders deleted."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        if not newest:
            return 0
        named = {x for v in kept for x in self._folders(v).values()}
        oldest = self.fs.getFileStatus(self._at(self._manifest(kept[0]))).getModificationTime()
        gone = 0
        for s in self.fs.listStatus(self._at("manifests")):
            name = s.getPath().getName()
            if name[:12].isdigit() and int(name[:12]) < kept[0]:
                self.fs.delete(s.getPath(), False)
        if self.fs.exists(self._at("data")):
            for s in self.fs.listStatus(self._at("data")):
                # a writer that hasn't committed yet has newer folders
                if f"data/{s.getPath().getName()}" not in named and s.getModificationTime() < oldest:
                    gone += bool(self.fs.delete(s.getPath(), True))
        return gone


# --- backups -----------------------------------------------------------------


def backup(tables: dict[str, DataFrame]) -> DataFrame:
    """(line): a library as JSON lines: the format, then collections, items and searches."""
    spark = tables["collections"].sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.lit("header").alias("kind"), F.lit(FORMAT).alias("format"))).alias("line"))
    kinds = {"collections": "collection", "items": "item", "searches": "search"}
    for name, kind in kinds.items():
        df = tables[name]
        head = head.unionByName(df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *(F.col(c) for c in df.columns))).alias("line")))
    return head


_LINE = "kind string, format string, id long, name string, description string, color string, collection_id long, corpus string, note string, tags array<string>, position int, query string"


def restore(lines: DataFrame, tables: dict[str, DataFrame], corpus: str) -> dict[str, DataFrame]:
    """The tables with a backup (line) added: collections and searches get new ids behind those that are there.

    Items follow their collection; one of a collection that the backup lacks is
    an error, as are another format and a line that can't be read. A repeated
    item is kept once, the first by position; items without a position come
    after the others. What has no corpus gets ``corpus``; a collection without a
    name is ``Untitled``. A search by a collection that the backup lacks gets -1,
    so that it never points to another one.
    """
    rows = lines.select(F.from_json("line", _LINE, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    formats = {r.format for r in rows.filter("kind = 'header'").select("format").collect()}  # one row
    if formats != {FORMAT}:
        raise ValueError(f"no backup: {sorted(map(str, formats))}")
    bad = rows.filter("kind IS NULL OR kind NOT IN ('header', 'collection', 'item', 'search') OR (kind IN ('item', 'collection') AND id IS NULL)").count()
    if bad:
        raise ValueError(f"{bad} lines can't be read")
    olds = rows.filter("kind = 'collection'").dropDuplicates(["id"])
    numbered = lambda df, there: df.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))).crossJoin(F.broadcast(there.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))).withColumn("new", F.col("top") + F.col("k"))  # noqa: E731  a person's collections and searches
    ids = numbered(olds, tables["collections"])
    new = ids.select(F.col("id").alias("old"), "new")
    strays = rows.filter("kind = 'item'").join(new, F.col("collection_id") == F.col("old"), "left_anti").count()
    if strays:
        raise ValueError(f"{strays} items without their collection")
    text = lambda c, d: F.when(F.btrim(F.coalesce(c, F.lit(""))) == "", F.lit(d)).otherwise(F.col(c))
    collections = ids.select(F.col("new").cast("int").alias("id"), text("name", "Untitled").alias("name"), F.coalesce("description", F.lit("")).alias("description"), text("color", "indigo").alias("color"))
    items = rows.filter("kind = 'item'").join(new, F.col("collection_id") == F.col("old")).withColumn("corpus", F.coalesce("corpus", F.lit(corpus)))
    own = Window.partitionBy("new", "corpus", "id").orderBy(F.col("position").asc_nulls_last(), "note")
    items = items.withColumn("same", F.row_number().over(own)).filter("same = 1")
    last = F.coalesce(F.max("position").over(Window.partitionBy("new")), F.lit(0))
    after = F.row_number().over(Window.partitionBy("new", F.col("position").isNull()).orderBy("id", "corpus"))
    items = items.withColumn("position", F.coalesce("position", last + after))
    items = items.select(F.col("new").cast("int").alias("collection_id"), "corpus", "id", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col("position").cast("int").alias("position"))
    searches = numbered(rows.filter("kind = 'search'").withColumn("id", F.coalesce("id", F.lit(0))), tables["searches"]).withColumnRenamed("new", "number")
    searches = searches.join(new, F.col("collection_id") == F.col("old"), "left")
    target = F.when(F.col("collection_id").isNull(), F.lit(None)).otherwise(F.coalesce("new", F.lit(-1)))
    searches = searches.select(F.col("number").cast("int").alias("id"), F.coalesce("name", "query", F.lit("Search")).alias("name"), F.coalesce("corpus", F.lit(corpus)).alias("corpus"), F.coalesce("query", F.lit("")).alias("query"), target.cast("int").alias("collection_id"))
    return {"collections": tables["collections"].unionByName(collections), "items": tables["items"].unionByName(items), "searches": tables["searches"].unionByName(searches)}
