"""Token index: postings with positions, token lists and a vocabulary, written once and read by search, trend and keyness.

A row of ``forward`` has what a speech is ranked and ordered by, and its tokens;
columns that aren't asked for aren't read. Postings (token, id, tf, dl, at) hold
the places of the token in the speech. They are range-partitioned and sorted by
token, so that files and row groups without a wanted token are skipped by their
statistics; a common token spreads over several files. The places are written
as deltas, bit-packed. A phrase is where the shifted places of its words meet,
so no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of
from ..functions.stats import bm25, idf, reliability
from ..functions.text import index_tokens
from ..plans.query import Leaf, parse
from .keyness import judged
from .trend import Term, calendar

#: What results are ordered by, kept beside the tokens where the corpus has it.
KEYS = ("date", "num_session", "ord", "nwords")


def _postings(batches) -> Iterator[pa.RecordBatch]:
    """A posting for each distinct token of each row, with its places in order. All in arrays: a batch is sorted by row and token once."""
    for batch in batches:
        lists = batch.column("tokens")
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            continue
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array(lists.value_lengths().fill_null(0))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = owner * len(flat.dictionary) + codes
        order = np.argsort(key, kind="stable")
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1])
        head = order[starts]
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        cols = [flat.dictionary.take(pa.array(codes[head])), batch.column("id").take(pa.array(owner[head])), pa.array(np.diff(np.append(starts, len(order))), pa.int32()), pa.array(sizes[owner[head]], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(at[order], pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["token", "id", "tf", "dl", "at"])


def build(corpus: DataFrame, path: str) -> Index:
    """Writes an index of the corpus to a folder. ``id`` is the key of the corpus; an empty corpus gives an empty index.

    The texts are read once. One shuffle deals the postings out by token.
    """
    spark = corpus.sparkSession
    tokens = index_tokens(F.col("speech"))
    kept = [k for k in KEYS if k in corpus.columns]
    rows = corpus.select("id", month_of(F.col("date")).alias("month"), *kept, tokens.alias("tokens")).withColumn("dl", F.size("tokens"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/forward")
    kind = dict(rows.dtypes)["id"]
    postings = spark.read.schema(rows.schema).parquet(f"{path}/forward").select("id", "tokens").mapInArrow(_postings, f"token string, id {kind}, tf int, dl int, at array<int>")
    postings = postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    postings.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(f"{path}/postings")
    found = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    found.groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("count")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    return Index(spark, path)


def phrase_places(places: list[Column]) -> Column:
    """How often words stand in a row, from the sorted places of each: those of the first that are one before one of the second, and so on."""

    def moved(p: Column, k: int) -> Column:
        return F.transform(p, lambda x: x - k) if k else p

    return F.coalesce(F.size(reduce(F.array_intersect, (moved(p, k) for k, p in enumerate(places)))), F.lit(0))


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.forward = spark.read.parquet(f"{path}/forward")
        self.postings = spark.read.parquet(f"{path}/postings")
        self.lengths = self.forward.drop("tokens")
        self._vocabulary = spark.read.parquet(f"{path}/vocabulary")

    def sums(self) -> DataFrame:
        """One row (n, avgdl, tokens)."""
        return self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("tokens"))

    def counts(self, terms: list[tuple[str, ...]]) -> DataFrame:
        """(id, dl, tf0, tf1, ...) of the speeches that hold a word of the terms: how often each word or phrase stands in them."""
        words = sorted({w for t in terms for w in t})
        near = {w for t in terms if len(t) > 1 for w in t}
        place = {w: f"w{i}" for i, w in enumerate(words)}
        some = self.postings.filter(F.col("token").isin(*words)).groupBy("id", "dl")
        single = [F.sum(F.when(F.col("token") == w, F.col("tf")).otherwise(0)).alias(f"n_{place[w]}") for w in words]
        at = [F.first(F.when(F.col("token") == w, F.col("at")), ignorenulls=True).alias(place[w]) for w in words if w in near]
        count = lambda t: F.col(f"n_{place[t[0]]}") if len(t) == 1 else phrase_places([F.col(place[w]) for w in t])
        return some.agg(*single, *at).select("id", "dl", *(count(t).cast("long").alias(f"tf{i}") for i, t in enumerate(terms)))

    def _counted(self, query: str) -> tuple[DataFrame, list[tuple[str, ...]], Column]:
        """Rows of ``counts``, the terms, and the query's condition on them."""
        q = parse(query)
        terms = q.terms()

        def build_(n) -> Column:
            if isinstance(n, Leaf):
                return F.col(f"tf{terms.index(n.tokens)}") > 0
            return reduce((lambda a, b: a & b) if n.op == "and" else (lambda a, b: a | b), map(build_, n.parts))

        return self.counts(terms), terms, build_(q.tree)

    def match(self, query: str) -> DataFrame:
        """(id) of the speeches that a query matches."""
        rows, _, hit = self._counted(query)
        return rows.filter(hit).select("id")

    def scores(self, query: str) -> DataFrame:
        """(id, score) by BM25, as ``search.scores`` gives it from the texts."""
        rows, terms, hit = self._counted(query)
        df = rows.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
        joined = rows.filter(hit).crossJoin(F.broadcast(df)).crossJoin(F.broadcast(self.sums()))  # one row each
        parts = [bm25(idf(F.col("n"), F.col(f"df{i}")), F.col(f"tf{i}"), F.col("dl"), F.col("avgdl")) for i in range(len(terms))]
        return joined.select("id", reduce(lambda a, b: a + b, parts).alias("score"))

    def search(self, corpus: DataFrame, query: str, limit: int = 50, offset: int = 0, order: str = "relevance", chosen: DataFrame | None = None) -> DataFrame:
        """The page of ``search.search``. Of the corpus the rows of the page alone are read."""
        from . import search

        ranked = self.scores(query)
        if chosen is not None:
            ranked = ranked.join(chosen.select("id"), "id", "left_semi")
        return search.search(corpus, query, limit, offset, order, ranked=ranked, keys=self.lengths)

    def id_list(self, query: str, order: str = "relevance", cap: int = -1) -> DataFrame:
        """(id) of all results in order, or of the first ``cap``."""
        from . import search

        if order == "relevance":
            out = self.scores(query).orderBy(F.col("score").desc(), "id")
        else:
            out = self.lengths.join(self.match(query), "id", "left_semi").orderBy(*search.order_columns(order))
        return (out if cap < 0 else out.limit(cap)).select("id")

    def vocabulary(self, prefix: str = "") -> DataFrame:
        """(token, docs, count), of tokens with a prefix."""
        return self._vocabulary.filter(F.startswith("token", F.lit(prefix))) if prefix else self._vocabulary

    def keyness(self, collection: DataFrame, **options) -> DataFrame:
        """The rows of ``keyness.keyness`` for a collection (id) of the corpus: its own token lists, and the vocabulary for the rest."""
        inside = self.forward.select("id", "tokens").join(collection.select("id").distinct(), "id", "left_semi")
        a = inside.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("a"))
        counts = self._vocabulary.select(F.col("token").alias("term"), F.col("count").alias("k")).join(a, "term", "left")
        return judged(counts.select("term", F.coalesce("a", F.lit(0)).alias("a"), "k"), **options)

    def monthly(self, corpus: DataFrame, terms: list[Term]) -> DataFrame:
        """The rows of ``trend.monthly``; of the corpus the dates alone are read."""
        exact = [t for t in terms if t.kind != "prefix"]
        per = self.counts([tuple(t.tokens) for t in exact]) if exact else None
        names = {t.key: f"tf{i}" for i, t in enumerate(exact)}
        prefixes = [t for t in terms if t.kind == "prefix"]
        if prefixes:
            begins = [F.startswith("token", F.lit(t.tokens[0])) for t in prefixes]
            some = self.postings.filter(reduce(lambda x, y: x | y, begins)).groupBy("id").agg(*(F.sum(F.when(b, F.col("tf")).otherwise(0)).alias(f"p{i}") for i, b in enumerate(begins)))
            names |= {t.key: f"p{i}" for i, t in enumerate(prefixes)}
            per = some if per is None else per.join(some, "id", "full_outer")
        per = per.select("id", *(F.coalesce(names[t.key], F.lit(0)).alias(f"c{i}") for i, t in enumerate(terms)))
        dated = self.lengths.filter("month IS NOT NULL")
        sums = dated.groupBy("month").agg(F.sum("dl").alias("tokens"), F.count("*").alias("speeches"))
        hits = per.join(dated.select("id", "month"), "id").groupBy("month").agg(*(F.sum(f"c{i}").alias(f"n{i}") for i in range(len(terms))), *(F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
        wide = calendar(corpus).join(sums, "month", "left").join(hits, "month", "left")
        each = F.explode(F.array(*(F.struct(F.lit(t.key).alias("term"), F.coalesce(f"n{i}", F.lit(0)).alias("count"), F.coalesce(f"d{i}", F.lit(0)).alias("docs")) for i, t in enumerate(terms))))
        out = wide.select("month", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("speeches", F.lit(0)).alias("speeches"), each.alias("e"))
        return out.select("e.term", "month", "e.count", "e.docs", "tokens", "speeches", reliability(F.col("tokens")).alias("reliability"))
