"""Page heads that recur through a session, and kinds of paragraphs labelled as a sequence."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from . import document

# --- running heads -----------------------------------------------------------


def normal_line(line: Column) -> Column:
    """A line folded, with every number as ``#``, so that heads of different pages are alike."""
    return F.regexp_replace(F.btrim(fold(line)), "[0-9]+", "#")


def _is_head_like(line: Column, final: str) -> Column:
    marked = F.substring(line, -1, 1).isin(*final) if final else F.lit(False)
    return F.char_length(line).between(3, 90) & line.rlike(r"[\p{L}#]") & ~marked


def running_heads(corpus: DataFrame, least: int = 3, final: str = ".:;,") -> DataFrame:
    """(num_session, line, n): normal lines that recur in a session.

    Short lines that end with none of the ``final`` marks, ``least`` times if they have a number, as
    heads with page or date do, else twice as often. Counted by partial
    aggregation, so a line that every page has costs little.
    """
    lines = corpus.select("num_session", F.explode(F.split(F.coalesce("speech", F.lit("")), "\n")).alias("raw"))
    lines = lines.select("num_session", normal_line(F.col("raw")).alias("line")).filter(_is_head_like(F.col("line"), final))
    counts = lines.groupBy("num_session", "line").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= F.when(F.contains("line", F.lit("#")), least).otherwise(2 * least))


def without_heads(corpus: DataFrame, heads: DataFrame) -> DataFrame:
    """``corpus`` with these lines left out of its speeches; a session has few heads, gathered for it once."""
    sets = heads.groupBy("num_session").agg(F.collect_set("line").alias("__heads"))
    rows = corpus.join(sets, "num_session", "left")
    kept = F.filter(F.split("speech", "\n"), lambda x: ~F.array_contains("__heads", normal_line(x)))
    speech = F.when(F.col("__heads").isNull(), F.col("speech")).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn("speech", speech).select(*corpus.columns)


# --- kinds as a sequence -----------------------------------------------------

KINDS = ("par", "turn", "stage", "list", "table", "note", "head")
#: What a kind gains after another: rows of a table, items and notes come in runs, a head stands before something else.
FOLLOWS = {("list", "list"): 2.0, ("table", "table"): 2.0, ("note", "note"): 1.0, ("head", "head"): -1.0, ("head", "par"): 0.3, ("head", "turn"): 0.3, ("turn", "par"): 0.2, ("note", "par"): -0.5}
_CELLS = re.compile(r"\S {2,}\S|\t|\s\|\s")


def scores(text: str) -> list[float]:
    """How much one paragraph looks like each of ``KINDS``."""
    lines = [x for x in text.split("\n") if x.strip()]
    letters = [c for c in text if c.isalpha()]
    words = len(text.split())
    share = lambda f: sum(map(bool, map(f, lines))) / max(1, len(lines))
    capitals = sum(c.isupper() for c in letters) / max(1, len(letters))
    one = len(lines) == 1 and 0 < len(letters) <= 120 and not text.rstrip().endswith(".")
    return [
        0.5 + min(words, 60) / 60,
        3.0 if document._TURN.match(text) else -4.0,
        5.0 if document._STAGE.match(text) else -5.0,
        4 * share(document._LIST.match) - 2 + (0.5 if words <= 25 else -0.5),
        4 * share(_CELLS.search) - 2 + (0.5 if words <= 25 else -0.5),
        3.0 if document._NOTE.match(text) else -3.0,
        5 * capitals - 2.2 if one else -4.0,
    ]


def label(paragraphs: list[str]) -> list[str]:
    """The kinds with the largest sum of scores and of what they gain after each other (Viterbi); ties go to the kind named first."""
    if not paragraphs:
        return []
    n = len(KINDS)
    gain = [[FOLLOWS.get((a, b), 0.0) for b in KINDS] for a in KINDS]
    best, came = scores(paragraphs[0]), []
    for text in paragraphs[1:]:
        own = scores(text)
        back = [max(range(n), key=lambda a, b=b: (best[a] + gain[a][b], -a)) for b in range(n)]
        best = [best[back[b]] + gain[back[b]][b] + own[b] for b in range(n)]
        came.append(back)
    k = max(range(n), key=lambda b: (best[b], -b))
    out = [k]
    for back in reversed(came):
        k = back[k]
        out.append(k)
    return [KINDS[k] for k in reversed(out)]


def labelled(text: Column) -> Column:
    """Blocks (kind, start, end) of a text, its kinds labelled as a sequence; offsets as ``document`` gives them."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        out = []
        for t in texts.to_pylist():
            spans = document.paragraphs(t or "")
            kinds = label([t[a:b] for a, b in spans])
            out.append([{"kind": k, "start": a, "end": b} for k, (a, b) in zip(kinds, spans, strict=True)])
        return pa.array(out, shape)

    return run(text)


def labels(corpus: DataFrame) -> DataFrame:
    """(id, k, kind, start, end) of every paragraph; ``k`` counts from 0."""
    return corpus.select("id", F.posexplode(labelled(F.col("speech"))).alias("k", "b")).select("id", "k", "b.*")
