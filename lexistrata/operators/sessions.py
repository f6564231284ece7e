"""Sessions: groups of speeches by (date, num_session), positions, contexts, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("date", "num_session")


def sessions(corpus: DataFrame) -> DataFrame:
    """One row per session with its extent; ``contiguous`` if its ids have no holes."""
    out = corpus.groupBy(*KEY).agg(
        F.min("id").alias("session_id"), F.max("id").alias("id_max"), F.count("*").alias("n"), F.sum("nwords").alias("words"), F.min("ord").alias("ord_min"), F.max("ord").alias("ord_max")
    )
    return out.withColumn("contiguous", F.col("id_max") - F.col("session_id") + 1 == F.col("n"))


def positions(corpus: DataFrame) -> DataFrame:
    """(id, position, n_session): place of each speech in its session, by id."""
    w = Window.partitionBy(*KEY)
    return corpus.select("id", F.row_number().over(w.orderBy("id")).alias("position"), F.count("*").over(w).alias("n_session"))


def context(corpus: DataFrame, width: int = 1) -> DataFrame:
    """(id, before, after): ids of neighbours up to ``width`` turns away in the session's order."""
    w = Window.partitionBy(*KEY).orderBy("ord", "id")
    before = F.collect_list("id").over(w.rowsBetween(-width, -1))
    after = F.collect_list("id").over(w.rowsBetween(1, width))
    return corpus.select("id", before.alias("before"), after.alias("after"))


def turns_between(corpus: DataFrame, least_words: int = 45) -> DataFrame:
    """Pairs of neighbouring long turns of a session and the turns between them."""
    w = Window.partitionBy(*KEY).orderBy("ord", "id")
    ranked = corpus.select("id", *KEY, "nwords", F.row_number().over(w).alias("r"), "ord")
    long_ = ranked.filter(F.col("nwords") >= least_words)
    w2 = Window.partitionBy(*KEY).orderBy("ord", "id")
    return long_.select("id", F.lead("id").over(w2).alias("next_id"), (F.lead("r").over(w2) - F.col("r") - 1).alias("turns")).filter("next_id IS NOT NULL")


def outline(corpus: DataFrame) -> DataFrame:
    """Speeches of each session in order with their share of its words."""
    w = Window.partitionBy(*KEY)
    share = F.col("nwords") / F.sum("nwords").over(w)
    return corpus.select(*KEY, "ord", "id", "speaker", "nwords", share.alias("share"))


def enrich(index: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Sessions with what a sidecar table says of them, matched on first id, last id and size."""
    return index.join(sidecar, [index.session_id == sidecar.id_min, index.id_max == sidecar.side_max, index.n == sidecar.side_n], "left").drop("id_min", "side_max", "side_n")


def warnings(index: DataFrame) -> DataFrame:
    """(session_id, warnings): what to know of a session, the gravest first."""
    checks = [("no_date", F.col("date").isNull()), ("split", ~F.col("contiguous")), ("no_order", F.col("ord_min").isNull()), ("one_speech", F.col("n") == 1)]
    found = F.array(*(F.when(c, F.lit(k)) for k, c in checks))
    return index.select("session_id", F.filter(found, lambda x: x.isNotNull()).alias("warnings"))


def same_day(corpus: DataFrame) -> DataFrame:
    """(session_id, other): other sessions of the same date."""
    s = sessions(corpus).select("date", "num_session", "session_id")
    t = s.select("date", F.col("num_session").alias("num2"), F.col("session_id").alias("other"))
    return s.join(t, "date").filter("num_session <> num2").select("session_id", "other").distinct()


def texts(corpus: DataFrame, date: str | None, num_session: int | None, first: int = 0, most: int = 60, chars: int = 250_000) -> DataFrame:
    """Texts of a session from an order on, up to a number of speeches and characters."""
    rows = corpus.filter(F.col("date").eqNullSafe(F.lit(date)) & F.col("num_session").eqNullSafe(F.lit(num_session)) & (F.col("ord") >= first))
    page = rows.orderBy("ord", "id").limit(most)
    before = F.sum(F.length("speech")).over(Window.partitionBy("date", "num_session").orderBy("ord", "id").rowsBetween(Window.unboundedPreceding, -1))
    return page.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < chars).select("id", "ord", "speaker", "speech")
