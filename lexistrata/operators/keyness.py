"""Keyness: the lexicon of a collection against the rest of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import badge, log_likelihood, log_ratio
from ..functions.text import index_tokens, surface_tokens
from ..plans.query import STOP_WORDS


def term_counts(corpus: DataFrame, collection: DataFrame) -> DataFrame:
    """(term, a, k): occurrences in the collection and in the whole corpus, from one scan."""
    marked = corpus.select("id", index_tokens(F.col("speech")).alias("tokens")).join(collection.select("id").distinct().withColumn("inside", F.lit(1)), "id", "left")
    return marked.select("inside", F.explode("tokens").alias("term")).groupBy("term").agg(F.count("inside").alias("a"), F.count("*").alias("k"))


def keyness(corpus: DataFrame, collection: DataFrame, min_freq: int = 5, threshold: float = 10.83, stop_words: frozenset = STOP_WORDS) -> DataFrame:
    """(term, freq, ref, g2, log_ratio, badge) of over- and under-used terms.

    The collection is part of the corpus. Terms under ``min_freq`` in it are no
    candidates; the threshold comes first, then stop words, then single letters.
    A collection that is the whole corpus has no rest, and gives no rows.
    """
    return judged(term_counts(corpus, collection), min_freq, threshold, stop_words)


def judged(counts: DataFrame, min_freq: int = 5, threshold: float = 10.83, stop_words: frozenset = STOP_WORDS) -> DataFrame:
    """Keyness from counts (term, a, k) in the collection and in the whole corpus."""
    sums = counts.agg(F.sum("a").alias("c"), F.sum("k").alias("n"))
    rows = counts.filter(F.col("a") >= min_freq).crossJoin(F.broadcast(sums))  # one row
    a, b, c, d = F.col("a"), F.col("k") - F.col("a"), F.col("c"), F.col("n") - F.col("c")
    rows = rows.filter(d > 0).withColumn("g2", log_likelihood(a, b, c, d)).filter(F.abs("g2") >= threshold)
    if stop_words:
        rows = rows.filter(~F.col("term").isin(*sorted(stop_words)))
    rows = rows.filter(F.char_length("term") > 1)
    ratio = log_ratio(a, b, c, d)
    return rows.select("term", a.alias("freq"), b.alias("ref"), "g2", ratio.alias("log_ratio"), F.when(F.col("g2") > 0, badge(b, ratio)).alias("badge"))


def ranked(rows: DataFrame, limit: int | None = None, limit_negative: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """Over-used terms by G2 descending, under-used by G2 ascending; None or 0 positives is no limit, 0 negatives an empty list."""
    up = rows.filter("g2 > 0").orderBy(F.bround("g2", 2).desc(), "term")
    down = rows.filter("g2 < 0").orderBy(F.bround("g2", 2), "term")
    return (up.limit(limit) if limit else up), (down if limit_negative is None else down.limit(limit_negative))


def profile(corpus: DataFrame, collection: DataFrame) -> DataFrame:
    """(tokens, types, ttr) of the collection."""
    counts = term_counts(corpus, collection).filter("a > 0")
    return counts.agg(F.sum("a").alias("tokens"), F.count("*").alias("types")).withColumn("ttr", F.col("types") / F.col("tokens"))


def surface_forms(corpus: DataFrame) -> DataFrame:
    """(term, form, n): the commonest surface form of each folded term; ties go to the smaller form."""
    pairs = corpus.select(F.explode(F.arrays_zip(index_tokens(F.col("speech")).alias("term"), surface_tokens(F.col("speech")).alias("form"))).alias("p"))
    counts = pairs.select("p.*").groupBy("term", "form").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("form").alias("form"), F.col("n").alias("n")))
    return counts.groupBy("term").agg(best.alias("b")).select("term", "b.form", "b.n")


def coherent(corpus: DataFrame, collection: DataFrame) -> bool:
    """Whether every id of the collection is in the corpus."""
    return collection.select("id").join(corpus.select("id"), "id", "left_anti").isEmpty()
