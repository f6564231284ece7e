"""Monthly trend of words, prefixes and phrases, with denominators."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import calendar, month_index, month_of
from ..functions.stats import reliability
from ..functions.text import index_tokens, phrase_count
from ..plans.query import STOP_WORDS, QueryError, tokenise


@dataclass(frozen=True)
class Term:
    kind: str  # word, prefix, phrase
    tokens: tuple[str, ...]
    notices: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}:{' '.join(self.tokens)}"


def read_term(raw: str, variants: bool = False) -> Term:
    """A term from what a user types; ``variants`` makes a long enough bare word a prefix."""
    text = raw.strip()
    if not text:
        raise QueryError("empty", 0)
    quoted = text.startswith('"')
    if text.count('"') % 2:
        raise QueryError("quotes", text.rindex('"'))
    bare = re.sub(r'"[^"]*"', "", text)
    if re.search(r"\b(AND|OR|NOT)\b|NEAR\(", bare):
        raise QueryError("operator", 0)
    star = text.endswith("*") and not quoted
    if "*" in (text[:-1] if star else text):
        raise QueryError("asterisk", text.index("*"))
    tokens = tokenise(text)
    if not tokens:
        raise QueryError("no_words", 0)
    if star:
        if len(tokens) > 1:
            raise QueryError("asterisk", len(text) - 1)
        if len(tokens[0]) < 3:
            raise QueryError("short_prefix", 0)
        return Term("prefix", tokens)
    if len(tokens) > 1:
        return Term("phrase", tokens, ("variants_not_for_phrases",) if variants else ())
    if variants and not quoted and len(tokens[0]) >= 4 and tokens[0] not in STOP_WORDS:
        return Term("prefix", tokens)
    return Term("word", tokens)


def read_terms(raws: list[str], variants: bool = False, most: int = 12) -> list[Term]:
    """Distinct terms in order; too many raise."""
    terms = list({t.key: t for t in (read_term(r, variants) for r in raws)}.values())
    if len(terms) > most:
        raise QueryError("too_many_terms", 0)
    return terms


def _count(tokens, term: Term):
    if term.kind == "prefix":
        return F.size(F.filter(tokens, lambda x: F.startswith(x, F.lit(term.tokens[0]))))
    return phrase_count(tokens, list(term.tokens))


def monthly(corpus: DataFrame, terms: list[Term], allowed: DataFrame | None = None) -> DataFrame:
    """(term, month, count, docs, tokens, speeches, reliability) for every month and term.

    ``allowed`` masks numerators and denominators alike. Months without rows are
    there with zeros; rows without a date don't count.
    """
    rows = corpus.select("id", month_of(F.col("date")).alias("month"), index_tokens(F.col("speech")).alias("tokens"))
    if allowed is not None:
        rows = rows.join(allowed.select("id"), "id", "left_semi")
    counted = rows.filter("month IS NOT NULL").select("month", F.size("tokens").alias("dl"), *(_count(F.col("tokens"), t).alias(f"c{i}") for i, t in enumerate(terms)))
    sums = counted.groupBy("month").agg(
        F.sum("dl").alias("tokens"), F.count("*").alias("speeches"), *(F.sum(f"c{i}").alias(f"n{i}") for i in range(len(terms))), *(F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(terms)))
    )
    wide = calendar(corpus).join(sums, "month", "left")
    each = F.explode(F.array(*(F.struct(F.lit(t.key).alias("term"), F.coalesce(f"n{i}", F.lit(0)).alias("count"), F.coalesce(f"d{i}", F.lit(0)).alias("docs")) for i, t in enumerate(terms))))
    out = wide.select("month", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("speeches", F.lit(0)).alias("speeches"), each.alias("e"))
    return out.select("e.term", "month", "e.count", "e.docs", "tokens", "speeches", reliability(F.col("tokens")).alias("reliability"))


def month_sessions(corpus: DataFrame) -> DataFrame:
    """(month, sessions, first, last): sessions of each month, and its first and last date."""
    rows = corpus.select("date", "num_session", month_of(F.col("date")).alias("month")).filter("month IS NOT NULL").groupBy("month", "date", "num_session").agg(F.lit(1).alias("one"))
    return rows.groupBy("month").agg(F.count("*").alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last"))


def with_sessions(months: DataFrame, corpus: DataFrame) -> DataFrame:
    """A monthly series with sessions, first and last; months without any have 0 and nulls."""
    return months.join(month_sessions(corpus), "month", "left").fillna(0, ["sessions"])


def yearly(months: DataFrame) -> DataFrame:
    """Sums of a monthly series by year; with first and last date where it has them."""
    sums = [c for c in ("count", "docs", "tokens", "speeches", "sessions") if c in months.columns]
    ends = [f(c).alias(c) for c, f in (("first", F.min), ("last", F.max)) if c in months.columns]
    return months.groupBy("term", F.substring("month", 1, 4).cast("int").alias("year")).agg(*(F.sum(c).alias(c) for c in sums), *ends)


def metrics(series: DataFrame) -> DataFrame:
    """Adds density per 10,000 tokens and percent of speeches; null where nothing was said."""
    density = F.when(F.col("tokens") > 0, F.col("count") / F.col("tokens") * 10_000)
    percent = F.when(F.col("speeches") > 0, F.col("docs") / F.col("speeches") * 100)
    return series.withColumn("density", density).withColumn("percent", percent)


def segments(months: DataFrame, gap: int = 3) -> DataFrame:
    """Adds ``segment``: runs of months with tokens, cut where ``gap`` or more lie empty between."""
    full = months.filter("tokens > 0").withColumn("i", month_index(F.col("month")))
    w = Window.partitionBy("term").orderBy("i")
    new = F.coalesce((F.col("i") - F.lag("i").over(w) > gap).cast("int"), F.lit(1))
    return full.withColumn("new", new).withColumn("segment", F.sum("new").over(w)).drop("new")


def smoothed(months: DataFrame, size: int = 3, gap: int = 3, measure: str = "density") -> DataFrame:
    """(term, month, segment, and the measure): smoothed within a segment over the months around.

    ``density`` and ``percent`` are ratios of centred sums, ``count`` the centred mean.
    """
    half = size // 2
    w = Window.partitionBy("term", "segment").orderBy("i").rangeBetween(-half, half)
    values = {"density": F.sum("count").over(w) / F.sum("tokens").over(w) * 10_000, "percent": F.sum("docs").over(w) / F.sum("speeches").over(w) * 100, "count": F.avg("count").over(w)}
    return segments(months, gap).select("term", "month", "segment", values[measure].alias(measure))


def id_runs(corpus: DataFrame) -> DataFrame:
    """(month, first, last, n): runs of consecutive ids of a month."""
    rows = corpus.select("id", month_of(F.col("date")).alias("month")).filter("month IS NOT NULL")
    w = Window.partitionBy("month").orderBy("id")
    runs = rows.withColumn("g", F.col("id") - F.row_number().over(w))
    return runs.groupBy("month", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).drop("g")


def milestones_by_month(milestones: DataFrame, months: DataFrame) -> DataFrame:
    """Milestones placed on the months of a calendar."""
    return milestones.withColumn("month", F.substring("date", 1, 7)).join(months.select("month").distinct(), "month", "left_semi")


def thin(milestones: DataFrame, capacity: int) -> DataFrame:
    """At most ``capacity`` milestones: by rank, the last rank that doesn't fit thinned evenly."""
    by = Window.partitionBy(F.lit(0)).orderBy("rank", "date", "id")  # a short registry
    ranked = milestones.withColumn("k", F.row_number().over(by)).withColumn("before", F.count("*").over(Window.partitionBy(F.lit(0)).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)))
    sized = ranked.withColumn("size", F.count("*").over(Window.partitionBy("rank"))).withColumn("room", F.greatest(F.lit(0), F.lit(capacity) - F.col("before")))
    place = F.col("k") - F.col("before") - 1
    even = F.floor((place + 1) * F.col("room") / F.col("size")) > F.floor(place * F.col("room") / F.col("size"))
    return sized.filter(even).drop("k", "before", "size", "room")


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(token, docs, count)."""
    rows = corpus.select("id", F.explode(index_tokens(F.col("speech"))).alias("token"))
    per_doc = rows.groupBy("token", "id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("count"))


def prefix_forms(vocab: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    return vocab.filter(F.startswith("token", F.lit(prefix))).orderBy(F.col("count").desc(), "token").limit(k)


def suggestions(vocab: DataFrame, word: str, k: int = 3) -> list[str]:
    """Close forms of a word without hits, among the tokens with its first two letters; a single letter has none.

    A similarity of 0.75 leaves an edit distance of a quarter of both lengths at
    most, so what isn't near is left out before anything is collected.
    """
    if len(word) < 2:
        return []
    near = vocab.filter(F.startswith("token", F.lit(word[:2])) & (4 * F.levenshtein("token", F.lit(word)) <= F.char_length("token") + len(word)))
    rows = near.orderBy(F.col("count").desc(), "token").select("token").collect()
    return difflib.get_close_matches(word, [r.token for r in rows], k, 0.75)


def without_hits(vocab: DataFrame, term: Term, least_prefix: int = 3, k: int = 5) -> dict:
    """What to offer for a term that wasn't found.

    For a word its close forms; for a phrase the words that no speech has, with
    close forms of each; for a prefix the longest shorter one with tokens, and
    its commonest ``k``.
    """
    if term.kind == "phrase":
        known = {r.token for r in vocab.filter(F.col("token").isin(*term.tokens)).select("token").collect()}
        missing = [t for t in dict.fromkeys(term.tokens) if t not in known]
        return {"missing": missing, "alternatives": {t: suggestions(vocab, t) for t in missing}}
    if term.kind == "prefix":
        for size in range(len(term.tokens[0]) - 1, least_prefix - 1, -1):
            forms = [(r["token"], r["count"]) for r in prefix_forms(vocab, term.tokens[0][:size], k).collect()]
            if forms:
                return {"prefix": term.tokens[0][:size], "forms": forms}
        return {}
    return {"alternatives": suggestions(vocab, term.tokens[0])}
