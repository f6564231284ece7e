"""Multi-word expressions of two to seven tokens, counted exactly.

Candidates start and end with content words and hold nothing but content words
and connectors; they never cross punctuation. ``phrases`` counts them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import cut
from ..functions.stats import c_value, log_likelihood
from ..functions.text import index_tokens, spans, tokens_and_cuts
from . import phrases
from .phrases import CONNECTORS, NUMBERS


def token_type(t: Column) -> Column:
    """2 content, 1 connector, 0 neither."""
    return F.when(t.isin(*CONNECTORS), 1).when((F.char_length(t) >= 3) & ~t.rlike("[0-9]") & ~t.isin(*NUMBERS), 2).otherwise(0)


def typed_spans(corpus: DataFrame) -> DataFrame:
    """(id, s, t): the tokens of each span of the speeches, and their types."""
    rows = corpus.filter("dm_speech = 1").select("id", F.explode(spans(F.col("speech"))).alias("s"))
    return rows.withColumn("t", F.transform("s", token_type))


def candidates(corpus: DataFrame, longest: int = 7) -> DataFrame:
    """(id, gram, left, right): every candidate of the speeches, with its neighbours in the span."""
    return grams(typed_spans(corpus), longest)


def grams(rows: DataFrame, longest: int = 7) -> DataFrame:
    """The candidates of typed spans.

    Starts are exploded first, then the lengths up to the next token that is
    neither content nor connector.
    """
    rows = rows.filter(F.size("s") >= 2)
    starts = rows.select("id", "s", "t", F.explode(F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("t", i) == 2)).alias("i"))
    stop = F.array_position(F.slice("t", F.col("i") + 1, longest - 1), 0).cast("int")
    reach = F.least(F.when(stop == 0, longest).otherwise(stop), F.size("s") - F.col("i") + 1)
    starts = starts.withColumn("reach", reach).filter("reach >= 2")
    at = starts.select("id", "s", "i", F.explode(F.filter(F.sequence(F.lit(2), F.col("reach")), lambda n: F.element_at("t", F.col("i") + n - 1) == 2)).alias("n"))
    return at.select(
        "id", F.array_join(F.slice("s", F.col("i"), F.col("n")), " ").alias("gram"), F.when(F.col("i") > 1, F.element_at("s", F.col("i") - 1)).alias("left"), F.try_element_at("s", F.col("i") + F.col("n")).alias("right")
    )


def windows(rows: DataFrame, longest: int = 7, passes: int = 1, one: int = 0) -> DataFrame:
    """(id, pair, left, text, ends): the places of typed spans where candidates start.

    ``pair`` has the first two tokens, ``text`` all up to the one after the longest
    candidate, ``ends`` the lengths of the candidates. Of several passes, pass
    ``one`` has the places whose first token falls to it.
    """

    def ours(i: Column) -> Column:
        content = F.element_at("t", i) == 2
        return content if passes == 1 else content & (F.pmod(F.hash(F.element_at("s", i)), F.lit(passes)) == one)

    rows = rows.filter(F.size("s") >= 2)
    starts = rows.select("id", "s", "t", F.explode(F.filter(F.sequence(F.lit(1), F.size("s") - 1), ours)).alias("i"))
    stop = F.array_position(F.slice("t", F.col("i") + 1, longest - 1), 0).cast("int")
    reach = F.least(F.when(stop == 0, longest).otherwise(stop), F.size("s") - F.col("i") + 1)
    starts = starts.withColumn("reach", reach).filter("reach >= 2")
    ends = F.array_join(F.filter(F.sequence(F.lit(2), F.col("reach")), lambda n: F.element_at("t", F.col("i") + n - 1) == 2), ",")
    joined = lambda n: F.array_join(F.slice("s", F.col("i"), n), " ")
    out = starts.select("id", joined(F.lit(2)).alias("pair"), F.when(F.col("i") > 1, F.element_at("s", F.col("i") - 1)).alias("left"), joined(F.col("reach") + 1).alias("text"), ends.alias("ends"))
    return out.filter("ends <> ''")


def speech_shards(corpus: DataFrame) -> DataFrame:
    """The spans of the speeches as shards of ``phrases``."""
    return phrases.shards(corpus.filter("dm_speech = 1").select("id", tokens_and_cuts(F.col("speech")).alias("s")))


def counts(rows: DataFrame, least: int, longest: int = 7, beside: bool = False, places: int = 1 << 20) -> DataFrame:
    """(gram, f, docs), and ``most`` if ``beside``, of the candidates of typed spans met ``least`` times."""
    return _counts(phrases.shards(rows), least, longest, beside, places)


def _counts(held: DataFrame, least: int, longest: int, beside: bool = False, places: int = 1 << 20) -> DataFrame:
    words, salt = phrases.vocabulary(held)
    return phrases.named(phrases.count(held, salt, least, longest, beside, places).select("gram", "f", "docs", *["most"] * beside), words)


def frequent(corpus: DataFrame, least: int, longest: int = 7) -> DataFrame:
    """(gram, f, docs) of the candidates of the speeches met ``least`` times."""
    return _counts(speech_shards(corpus), least, longest)


def detect(corpus: DataFrame, least: int | None = None, least_docs: int = 3, extension: float = 0.8, g2_min: float = 10.83, longest: int = 7) -> DataFrame:
    """(form, n_tokens, freq, docs, independent, g2, c_value) of detected expressions.

    ``least`` defaults to the larger of 20 and a quarter of the millions of tokens.
    """
    if least is None:
        n = corpus.select(F.sum(F.size(index_tokens(F.col("speech")))).alias("n")).first().n or 0
        least = max(20, math.ceil(0.25 * n / 1e6))
    # texts are cut and folded once; all that follows reads the shards, and knows tokens by their hashes
    held = speech_shards(corpus)
    words, salt = phrases.vocabulary(held)
    every = phrases.count(held, salt, least, longest, beside=True)
    # a gram that mostly stands inside a longer one is dropped
    kept = every.filter((F.col("docs") >= least_docs) & (F.coalesce("most", F.lit(0)) < extension * F.col("f")))
    # association between all but the last content word's part and the last word
    total = words.agg(F.coalesce(F.sum("fp"), F.lit(0)).alias("n"))
    kept = kept.select("gram", "f", "docs", F.element_at("gram", -1).alias("last"), F.slice("gram", F.lit(1), F.col("head")).alias("head"))
    heads = every.select(F.col("gram").alias("head"), F.col("f").alias("fh")).unionByName(words.select(F.array("h").alias("head"), F.col("fp").alias("fh")))
    kept = kept.join(words.select(F.col("h").alias("last"), "fp"), "last").join(heads, "head").crossJoin(F.broadcast(total))  # one row
    g2 = log_likelihood(F.col("f"), F.col("fp") - F.col("f"), F.col("fh"), F.col("n") - F.col("fh"))
    kept = cut(kept.withColumn("g2", g2).filter(F.col("g2") >= g2_min).select("gram", "f", "docs", "g2"))
    # containers: longer kept grams that hold a gram
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.size("gram") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("gram") - n + 1), lambda i: F.slice("gram", i, n))))
    inside = kept.filter(F.size("gram") > 2).select(F.col("f").alias("cf"), F.explode(F.array_distinct(subs)).alias("gram"))
    around = inside.groupBy("gram").agg(F.max("cf").alias("most"), F.avg("cf").alias("mean"))
    out = kept.join(around, "gram", "left").withColumn("independent", F.col("f") - F.coalesce("most", F.lit(0))).filter(F.col("independent") >= least)
    value = c_value(F.size("gram"), F.col("f"), F.col("mean"))
    out = phrases.named(out.select("gram", F.size("gram").alias("n_tokens"), F.col("f").alias("freq"), "docs", "independent", "g2", value.alias("c_value")), words)
    return out.withColumnRenamed("gram", "form")


def listing(table: DataFrame, rejected: DataFrame | None = None, needle: str = "", order: str = "frequency") -> DataFrame:
    """The table without rejected forms, searched and ordered."""
    keys = {"frequency": [F.col("freq").desc(), F.col("form")], "alphabetic": [F.col("form")], "g2": [F.col("g2").desc(), F.col("form")], "length": [F.col("n_tokens").desc(), F.col("form")]}[order]
    out = table if rejected is None else table.join(rejected, "form", "left_anti")
    return out.filter(F.contains("form", F.lit(needle))).orderBy(*keys)


def occurrences(corpus: DataFrame, table: DataFrame, longest: int = 7) -> DataFrame:
    """(form, n): all occurrences, nested ones included."""
    found = candidates(corpus, longest).select(F.col("gram").alias("form"))
    return found.join(table.select("form"), "form", "left_semi").groupBy("form").agg(F.count("*").alias("n"))


def segment(tokens: list[str], forms: set[tuple[str, ...]], longest: int) -> list[str]:
    """Fewest units, then the largest sum of squared lengths; ties take the longer first unit."""
    n = len(tokens)
    best = [(0, 0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        choice = None
        for k in range(1, min(longest, n - i) + 1):
            if k == 1 or tuple(tokens[i : i + k]) in forms:
                units, square, _ = best[i + k]
                value = units + 1, square - k * k, -k
                if choice is None or value < choice:
                    choice = value
        best[i] = choice
    out, i = [], 0
    while i < n:
        k = -best[i][2]
        out.append(" ".join(tokens[i : i + k]))
        i += k
    return out


def units(corpus: DataFrame, forms: list[str]) -> DataFrame:
    """(id, units): speeches cut into expressions and single tokens. ``forms`` is a reviewed list, broadcast."""
    table = {tuple(f.split(" ")) for f in forms}
    longest = max(map(len, table), default=1)
    shared = corpus.sparkSession.sparkContext.broadcast((table, longest))

    @F.arrow_udf("array<string>")
    def run(spans_: pa.Array) -> pa.Array:
        known, most = shared.value
        return pa.array([[u for s in (x or []) for u in segment(s, known, most)] for x in spans_.to_pylist()], pa.list_(pa.string()))

    return corpus.select("id", run(spans(F.col("speech"))).alias("units"))


def commonest_surface(rows: DataFrame) -> DataFrame:
    """Keeps the commonest surface of each form; ties go to the smaller text."""
    w = Window.partitionBy("form").orderBy(F.col("n").desc(), "surface")
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


#: Changes when the rules of detection do.
VERSION = 1


def save(table: DataFrame, path: str, corpus_sha256: str) -> None:
    """Writes detected expressions with the version of the rules and the checksum of the corpus file."""
    table.withColumns({"version": F.lit(VERSION), "corpus": F.lit(corpus_sha256)}).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, corpus_sha256: str) -> DataFrame | None:
    """Saved expressions, or None if they are of other rules or another corpus."""
    table = spark.read.parquet(path)
    if not table.filter((F.col("version") != VERSION) | (F.col("corpus") != corpus_sha256)).isEmpty():
        return None
    return table.drop("version", "corpus")
