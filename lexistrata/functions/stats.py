"""Statistics as columns, after their published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed Dunning G2 of a in c tokens against b in d tokens; negative if rarer in the first."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, k = c + d, a + b

    def part(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log1p((o - e) / e)).otherwise(F.lit(0.0))

    e1, e2 = c * k / n, d * k / n
    g = 2 * (part(a, e1) + part(b, e2) + part(c - a, c - e1) + part(d - b, d - e2))
    g = F.greatest(g, F.lit(0.0))
    return F.when(a * d >= b * c, g).otherwise(-g)


def log_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Binary log of the ratio of relative frequencies; a zero counts as a half."""
    half = lambda x: F.when(x == 0, F.lit(0.5)).otherwise(x.cast("double"))
    return F.log2((half(a) / c) / (half(b) / d))


def badge(reference: Column, ratio: Column) -> Column:
    """Distinctiveness class of an over-used term."""
    return F.when((reference == 0) | (ratio >= 6), "exclusive").when(ratio >= 3, "marked").otherwise("common")


def c_value(tokens: Column, f: Column, mean_container: Column) -> Column:
    return F.log2(tokens.cast("double")) * (f - F.coalesce(mean_container, F.lit(0.0)))


def reliability(tokens: Column) -> Column:
    """How far a month's denominator can be trusted."""
    return F.when(tokens >= 100_000, "normal").when(tokens >= 20_000, "low").when(tokens > 0, "very_low").otherwise("empty")


def idf(n_docs: Column, df: Column) -> Column:
    """Inverse document frequency of BM25, floored."""
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def bm25(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def years_apart(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(a, b)) / 365.25
