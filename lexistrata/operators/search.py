"""Search: matching, BM25 ranking, pages, snippets, statistics of results."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import bm25, idf
from ..functions.text import index_tokens, phrase_count
from ..plans.query import Query, parse, predicate
from .filters import preview

META = ("id", "id_session", "num_session", "ord", "date", "legislature", "session_type", "speaker", "rep_id", "rep_name", "sex", "district", "party", "dm_speech", "nwords")


def order_columns(order: str) -> list[Column]:
    if order == "date_asc":
        return [F.col("date").asc_nulls_first(), F.col("num_session").asc(), F.col("ord").asc(), F.col("id").asc()]
    if order == "date_desc":
        return [F.col("date").desc_nulls_last(), F.col("num_session").desc(), F.col("ord").asc(), F.col("id").asc()]
    if order == "length_desc":
        return [F.col("nwords").desc(), F.col("id").asc()]
    if order == "length_asc":
        return [F.col("nwords").asc(), F.col("id").asc()]
    raise ValueError(f"no order {order}")


def indexed(corpus: DataFrame) -> DataFrame:
    """(id, tokens, dl): what matching and ranking read."""
    return corpus.select("id", index_tokens(F.col("speech")).alias("tokens")).withColumn("dl", F.size("tokens"))


def match(corpus: DataFrame, query: str) -> DataFrame:
    """Rows of the corpus that a query matches."""
    return corpus.filter(predicate(parse(query), index_tokens(F.col("speech"))))


def scores(corpus: DataFrame, query: str, chosen: DataFrame | None = None) -> DataFrame:
    """(id, score) of matching rows by BM25 over the query's distinct phrases.

    Frequencies and lengths are those of the whole corpus; ``chosen`` restricts
    the rows returned. One scan counts every phrase in every row, so no postings
    are shuffled.
    """
    q: Query = parse(query)
    terms = q.terms()
    base = indexed(corpus)
    counted = base.select("id", "dl", *(phrase_count(F.col("tokens"), list(t)).alias(f"tf{i}") for i, t in enumerate(terms)), predicate(q, F.col("tokens")).alias("hit"))
    sums = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = counted.filter("hit").crossJoin(F.broadcast(sums))  # one row
    parts = [bm25(idf(F.col("n"), F.col(f"df{i}")), F.col(f"tf{i}"), F.col("dl"), F.col("avgdl")) for i in range(len(terms))]
    out = joined.select("id", reduce(lambda a, b: a + b, parts).alias("score"))
    return out if chosen is None else out.join(chosen.select("id"), "id", "left_semi")


def search(
    corpus: DataFrame, query: str | None, limit: int = 50, offset: int = 0, order: str = "relevance", chosen: DataFrame | None = None, ranked: DataFrame | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """A page of results: metadata, snippet, score relative to the page's best.

    Ids are ranked first; metadata and text are fetched for the page alone.
    Without a query it browses: by date, with a preview and no score. ``ranked``
    (id, score) and ``keys`` (id and what results are ordered by) come from an
    index in place of the texts.
    """
    if not 1 <= limit <= 200 or not 0 <= offset <= 10_000_000:
        raise ValueError("limit must be 1 to 200, offset 0 to 10,000,000")
    if not query or not query.strip():
        rows = corpus if chosen is None else corpus.join(chosen.select("id"), "id", "left_semi")
        page = rows.orderBy(*order_columns("date_asc" if order == "relevance" else order)).offset(offset).limit(limit)
        return page.select(*META, preview(F.col("speech")).alias("snippet"), F.lit(None).cast("double").alias("score"))
    ranked = scores(corpus, query, chosen) if ranked is None else ranked
    if order == "relevance":
        page = ranked.orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)
    else:
        placed = (corpus if keys is None else keys).select("id", "date", "num_session", "ord", "nwords").join(ranked, "id")
        page = placed.orderBy(*order_columns(order)).offset(offset).limit(limit).select("id", "score")
    best = F.max("score").over(Window.partitionBy(F.lit(0)))  # the page holds at most 200 rows
    page = page.withColumn("score", F.bround(F.when(best == 0, F.lit(-1.0)).otherwise(F.col("score") / best), 4))
    rows = corpus.join(F.broadcast(page), "id")
    return rows.select(*META, snippet(F.col("speech"), query).alias("snippet"), "score")


def total(corpus: DataFrame, query: str) -> DataFrame:
    return match(corpus, query).agg(F.count("*").alias("total"))


def id_list(corpus: DataFrame, query: str | None, order: str = "relevance", cap: int = -1) -> DataFrame:
    """(id) of all results in order, or of the first ``cap``."""
    if query:
        ranked = scores(corpus, query)
        keys = [F.col("score").desc(), F.col("id")] if order == "relevance" else order_columns(order)
        rows = ranked if order == "relevance" else corpus.join(ranked, "id")
    else:
        rows, keys = corpus, order_columns("date_asc" if order == "relevance" else order)
    out = rows.orderBy(*keys)
    return (out if cap < 0 else out.limit(cap)).select("id")


def hit_ranges(text: str, terms: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Merged character ranges of all occurrences of phrases in a text."""
    import re

    from ..plans.query import fold_text

    found = [(m.start(), m.end(), fold_text(m.group())) for m in re.finditer(r"[^\W_]+", text)]
    toks = [t for _, _, t in found]
    ranges = []
    for term in terms:
        for i in range(len(toks) - len(term) + 1):
            if tuple(toks[i : i + len(term)]) == term:
                ranges.append((found[i][0], found[i + len(term) - 1][1]))
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _snip(text: str, terms: list[tuple[str, ...]], size: int) -> str:
    """The window of ``size`` tokens with the most distinct hits, hits marked; ties go to the first."""
    import re

    spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    hits = hit_ranges(text, terms)
    if not spots:
        return ""
    starts = [a for a, _ in spots]
    best, at = (-1, 0), 0
    # hits low to high are inside the window; both ends only move on
    low = high = 0
    inside: dict[str, int] = {}
    found = [text[x:y].lower() for x, y in hits]
    for i in range(max(1, len(spots) - size + 1)):
        a, b = starts[i], spots[min(len(spots), i + size) - 1][1]
        while high < len(hits) and hits[high][1] <= b:
            inside[found[high]] = inside.get(found[high], 0) + 1
            high += 1
        while low < high and hits[low][0] < a:
            inside[found[low]] -= 1
            if not inside[found[low]]:
                del inside[found[low]]
            low += 1
        score = len(inside), high - low
        if score > best:
            best, at = score, i
    a, b = starts[at], spots[min(len(spots), at + size) - 1][1]
    out, pos = ["… " if at else ""], a
    for x, y in hits:
        if x >= a and y <= b:
            out += [text[pos:x], "<<<", text[x:y], ">>>"]
            pos = y
    return "".join(out) + text[pos:b] + (" …" if b < spots[-1][1] else "")


def snippet(speech: Column, query: str, size: int = 38) -> Column:
    terms = parse(query).terms()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_snip(t or "", terms, size) for t in texts.to_pylist()], pa.string())

    return run(speech)


def statistics(hits: DataFrame) -> DataFrame:
    """(dim, value, n) over grouping sets: all years, sexes and types, top 15 parties, top 25 speakers."""
    dims = {"year": None, "sex": None, "session_type": None, "party": 15, "rep_name": 25}
    hits = hits.select(*(F.col(d).cast("string").alias(d) for d in dims), "rep_id")
    name = F.coalesce(*(F.when(F.grouping(d) == 0, F.lit(d)) for d in dims))
    value = F.coalesce(*(F.when(F.grouping(d) == 0, F.col(d)) for d in dims))
    grouped = hits.groupingSets([[F.col(d)] for d in dims], *(F.col(d) for d in dims)).agg(F.count("*").alias("n"), name.alias("dim"), value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()))
    most = F.coalesce(*(F.when(F.col("dim") == d, F.lit(k)) for d, k in dims.items() if k), F.lit(1 << 30))
    return grouped.withColumn("k", rank).filter(F.col("k") <= most).select("dim", "value", "n")


def by_year(hits: DataFrame) -> DataFrame:
    return hits.groupBy("year").agg(F.count("*").alias("n"))


def membership(page: DataFrame, items: DataFrame) -> DataFrame:
    """(id, collections): the collections that hold each id of a page, in order."""
    return page.select("id").join(items.select("id", "collection_id"), "id", "left").groupBy("id").agg(F.array_sort(F.collect_set("collection_id")).alias("collections"))
