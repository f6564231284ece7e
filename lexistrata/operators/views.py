"""Views over results: corpus information, rings and ego networks, themes as queries, intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import index_tokens
from ..plans.query import fold_text
from .sessions import KEY


def corpus_info(corpus: DataFrame) -> DataFrame:
    """(key, value) of the facts that introduce a corpus."""
    one = corpus.agg(
        F.count("*").alias("rows"), F.sum("nwords").alias("words"), F.sum("nbytes").alias("bytes"), F.countDistinct("num_session").alias("sessions"), F.countDistinct("party").alias("parties"),
        F.countDistinct("rep_id").alias("speakers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum(F.size(index_tokens(F.col("speech")))).alias("tokens"),
    )
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*(F.col(c).cast("long") for c in one.columns)))).alias("key", "value"))


def median_turns(corpus: DataFrame) -> DataFrame:
    """(date, num_session, rep_id, turns, median_words): the upper median of a speaker's turn lengths in a session."""
    rows = corpus.filter("rep_id IS NOT NULL")
    w = Window.partitionBy(*KEY, "rep_id")
    ranked = rows.select(*KEY, "rep_id", "nwords", (F.row_number().over(w.orderBy("nwords", "id")) - 1).alias("k"), F.count("*").over(w).alias("turns"))
    return ranked.filter(F.col("k") == F.floor(F.col("turns") / 2)).select(*KEY, "rep_id", "turns", F.col("nwords").alias("median_words"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion."""
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def iso_date(c: Column) -> Column:
    """A date of YYYY-MM-DD, YYYYMMDD, or an ISO week date; null for anything else."""
    plain = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))).when(c.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd"))))
    week = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
    part = lambda k: F.regexp_extract(c, week, k)
    day = F.coalesce(F.when(part(3) != "", part(3).try_cast("int")), F.lit(1))
    fourth = F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    found = F.date_add(monday, (part(2).try_cast("int") - 1) * 7 + day - 1)
    return F.coalesce(plain, F.when(c.rlike(week) & part(2).try_cast("int").between(1, 53) & (F.extract(F.lit("YEAROFWEEK"), found) == part(1).try_cast("int")), found))


def rings(nodes: DataFrame, score: str, cuts: tuple[float, ...] = (0.03, 0.10, 0.25, 0.55)) -> DataFrame:
    """Adds ``ring`` 0..len(cuts) by rank, equal scores in one ring. For the nodes of a drawn network."""
    whole = Window.partitionBy(F.lit(0))
    place = (F.rank().over(whole.orderBy(F.col(score).desc())) - 1) / F.count("*").over(whole)
    return nodes.withColumn("ring", sum((place >= c).cast("int") for c in cuts))


def ego(edges: DataFrame, node: str, direction: str = "both", least: int = 1) -> DataFrame:
    """Edges of one node by direction and least weight."""
    sides = {"out": F.col("a") == node, "in": F.col("b") == node, "both": (F.col("a") == node) | (F.col("b") == node)}
    if direction not in sides:
        raise ValueError(f"no direction {direction}")
    return edges.filter(sides[direction] & (F.col("n") >= least))


def theme_query(terms: list[str]) -> str:
    """The query that finds the speeches of a theme: its terms joined by OR, longer ones as phrases."""
    return " | ".join(f'"{t}"' if " " in t else t for t in dict.fromkeys(terms))


def theme_ranges(text: str, terms: list[str]) -> list[tuple[int, int, str]]:
    """Character ranges of a theme's terms, the longest that begins earliest first, without overlap."""
    spots = [(m.start(), m.end(), fold_text(m.group())) for m in re.finditer(r"[^\W_]+", text)]
    forms = {tuple(fold_text(t).split()): t for t in terms}
    longest = max(map(len, forms), default=0)
    out, i = [], 0
    while i < len(spots):
        for n in range(min(longest, len(spots) - i), 0, -1):
            form = tuple(s[2] for s in spots[i : i + n])
            if form in forms:
                out.append((spots[i][0], spots[i + n - 1][1], forms[form]))
                i += n
                break
        else:
            i += 1
    return out


def seed_terms(terms: list[tuple[str, ...]], most: int = 8) -> list[str]:
    """Terms of a query as first terms of a trend."""
    return [t[0] if len(t) == 1 else '"' + " ".join(t) + '"' for t in terms[:most]]
