"""Turns of the chair: by label, by formula, by repeated passages, and by who has how many turns of what length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold
from .speakers import role

#: How turns of the chair or the secretariat begin, and what they say; folded.
OPENINGS = r"^\s*(por instrucciones de la presidencia|se levanta la sesion|se abre la sesion|se va a dar lectura|se da cuenta|orden del dia|no habiendo discusion|se abre a votacion|the (sitting|session) (is|was) (opened|closed)|order of the day)"
FORMULAS = r"tiene (usted )?la palabra|se le concede la palabra|a discusion|se somete|los que esten (de acuerdo|por la afirmativa)|queda aprobad|se aprueba|se abre el registro|votacion|secretaria|has the floor"
#: A label of a seat: a party in parentheses, or the name of the mandate.
SEAT = r"\([^)]*\p{Lu}{2,}[^)]*\)|(?i:diputad|deputad|asamble[ií]sta|representante|congresista|legislador|senador)"
CHAIR_ROLES = ("chair", "vicechair", "chair_age", "secretary")


# --- repeated passages -------------------------------------------------------


def fingerprints(text: str | None, k: int, window: int) -> list[tuple[int, int]]:
    """(hash, word place) by winnowing: of each ``window`` consecutive hashes of ``k`` words the smallest, the last of equals.

    Any passage of ``k + window - 1`` words that two texts share gives them a
    hash in common. Texts of fewer than ``k`` words have none.
    """
    words = (text or "").lower().split()
    n = len(words) - k + 1
    if n < 1:
        return []
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    hashes = np.zeros(n, np.uint64)
    for i in range(k):  # modulo 2**64
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    hashes ^= hashes >> np.uint64(31)
    hashes = hashes.astype(np.int64)
    w = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)
    chosen: list[int] = []
    step = max(1, (1 << 22) // w)
    for a in range(0, len(views), step):
        part = views[a : a + step]
        last = np.arange(a, a + len(part)) + w - 1 - np.argmin(part[:, ::-1], axis=1)
        chosen += np.unique(last).tolist()
    at = np.unique(np.array(chosen))
    return list(zip(hashes[at].tolist(), at.tolist(), strict=True))


def passages(turns: DataFrame, k: int = 8, window: int = 16, text: str = "speech") -> DataFrame:
    """(num_session, ord, id, hash, at) of each fingerprint."""

    @F.arrow_udf("array<struct<hash:bigint,at:int>>")
    def run(texts: pa.Array) -> pa.Array:
        shape = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
        return pa.array([[{"hash": h, "at": a} for h, a in fingerprints(t, k, window)] for t in texts.to_pylist()], shape)

    return turns.select("num_session", "ord", "id", F.explode(run(F.col(text))).alias("f")).select("num_session", "ord", "id", "f.*")


def repeated(turns: DataFrame, k: int = 8, window: int = 16, share: float = 0.8, least: int = 200, text: str = "speech") -> DataFrame:
    """(id, met, prints): turns of ``least`` characters most of whose fingerprints an earlier turn of the session has.

    Each hash of a session has one first turn, found by partial aggregation; a
    passage that every turn repeats costs each of them one row.
    """
    marks = passages(turns.filter(F.length(text) >= least), k, window, text).select("num_session", "ord", "id", "hash").distinct()
    first = marks.groupBy("num_session", "hash").agg(F.min(F.struct("ord", "id")).alias("first"))
    met = marks.join(first, ["num_session", "hash"]).groupBy("id").agg(F.count_if(F.struct("ord", "id") > F.col("first")).alias("met"), F.count("*").alias("prints"))
    return met.filter(F.col("met") >= share * F.col("prints"))


# --- shares ------------------------------------------------------------------


_MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)"  # the upper one


def shares(turns: DataFrame, least: int = 5, by: str = "rep_id") -> DataFrame:
    """(num_session, person, why): who must be in the chair by the turns of a session in which no label says so.

    ``turns`` has num_session, ``by``, and size in characters. The one with
    most turns (ties to the smaller name), if these are a quarter of all and at
    least ``least``, and are short in the median (400) or a third of all
    (35 %); then others with 15 % and a median of 250, as secretaries.
    """
    counts = turns.filter(F.col(by).isNotNull()).groupBy("num_session", F.col(by).alias("person")).agg(F.count("*").alias("n"), F.expr(_MEDIAN.format("size")).alias("median"))
    session = Window.partitionBy("num_session")
    counts = counts.withColumn("all", F.sum("n").over(session)).withColumn("k", F.row_number().over(session.orderBy(F.desc("n"), "person")))
    chair = (F.col("k") == 1) & (F.col("n") >= 0.25 * F.col("all")) & (F.col("n") >= least) & ((F.col("median") <= 400) | (F.col("n") >= 0.35 * F.col("all")))
    counts = counts.withColumn("chair", chair).withColumn("held", F.max("chair").over(session))
    clerk = F.col("held") & (F.col("k") > 1) & (F.col("n") >= least) & (F.col("n") >= 0.15 * F.col("all")) & (F.col("median") <= 250)
    return counts.filter(F.col("chair") | clerk).select("num_session", "person", F.when(F.col("chair"), "share").otherwise("clerk").alias("why"))


def chair_turns(corpus: DataFrame, least: int = 5) -> DataFrame:
    """(id, why): turns of the chair or the secretariat, with the sorted reasons.

    ``label``: the speaker's label says so. ``opening``: the turn begins with a
    formula. ``repeated``: its passages were heard before in the session. In
    sessions without a label also ``share`` and ``clerk`` by number and length
    of turns, and ``formula``: half of a person's turns, three at least, hold
    one and are short. ``name``: turns under the bare name of who is in the
    chair by a label, if there are as many of them, a fifth of the session's,
    and they are short.
    """
    text = F.coalesce(F.col("speech"), F.lit(""))
    base = corpus.select("id", "num_session", "ord", "rep_id", "speaker", "speech", F.length(text).alias("size"), role(F.col("speaker")).isin(*CHAIR_ROLES).alias("labelled"))
    base = base.withColumn("opens", fold(F.substring(text, 1, 200)).rlike(OPENINGS)).withColumn("says", fold(text).rlike(FORMULAS))
    light = base.drop("speech").withColumn("seat", F.coalesce(F.col("speaker").rlike(SEAT), F.lit(False)))
    reasons = [light.filter("labelled").select("id", F.lit("label").alias("why")), light.filter("opens").select("id", F.lit("opening").alias("why")), repeated(base).select("id", F.lit("repeated").alias("why"))]
    bare = light.filter("rep_id IS NOT NULL").join(light.filter("labelled").select("num_session").distinct(), "num_session", "left_anti")
    who = shares(bare, least)
    said = bare.groupBy("num_session", F.col("rep_id").alias("person")).agg(F.count("*").alias("n"), F.count_if("says").alias("c"), F.expr(_MEDIAN.format("size")).alias("median"))
    said = said.filter("c >= 3 AND c >= 0.5 * n AND median <= 400").select("num_session", "person", F.lit("formula").alias("why"))
    turns = bare.select("id", "num_session", F.col("rep_id").alias("person"))
    reasons += [turns.join(w, ["num_session", "person"]).select("id", "why") for w in (who, said)]
    known = light.withColumn("mesa", F.col("labelled") | F.col("opens"))
    every = known.groupBy("num_session").agg(F.count("*").alias("all"))
    own = ~F.col("mesa") & ~F.col("seat")
    by = known.filter("rep_id IS NOT NULL").groupBy("num_session", "rep_id").agg(F.count_if("mesa").alias("chair"), F.count_if(own).alias("own"), F.expr(_MEDIAN.format("CASE WHEN NOT mesa AND NOT seat THEN size END")).alias("median"))
    named = by.join(every, "num_session").filter("chair > 0 AND own > 0 AND own >= chair AND own >= 0.2 * all AND median <= 400").select("num_session", "rep_id")
    reasons.append(known.filter(own).join(named, ["num_session", "rep_id"]).select("id", F.lit("name").alias("why")))
    out = reasons[0]
    for r in reasons[1:]:
        out = out.unionByName(r)
    return out.groupBy("id").agg(F.array_sort(F.collect_set("why")).alias("why"))


def floor_turns(corpus: DataFrame, least: int = 5) -> DataFrame:
    """``corpus`` without the turns of the chair."""
    return corpus.join(chair_turns(corpus, least).select("id"), "id", "left_anti")
