"""Replies: within a session by allusions and closeness, across sessions by likeness of terms."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import bm25, idf, years_apart
from ..functions.text import ascii_tokens
from ..plans.query import STOP_WORDS, fold_text
from .sessions import KEY
from .speakers import bare_label, role

#: Weights of the score.
NAME, OFFICE, INTERRUPTION, TURN, OTHER_PARTY, EXTRA, EXTRA_CAP = 40.0, 30.0, 15.0, 30.0, 12.0, 3.0, 9.0
_CHAIR = ("chair", "vicechair", "chair_age", "summary", "remark")
_HONORIFIC = re.compile(r"\b(senor|senora|sr|sra|don|dona|diputad[oa]|companer[oa]|mr|mrs|ms)\.?\s+$")


def allusions(text: str | None, name: str | None, office: str | None) -> tuple[int, int, int]:
    """(by name, by office, interruptions) of a person in a text.

    A surname counts behind an honorific, or if it has two parts and a capital.
    Inside parentheses a label with a colon is an interruption, anything else is
    a stage direction and doesn't count.
    """
    return _count(_read(text), name, office) if text else (0, 0, 0)


def _read(text: str) -> tuple[str, str, list]:
    """(text, folded text, parentheses), of one length."""
    flat = fold_text(text)
    if len(flat) != len(text):
        text = flat
    return text, flat, [(m.start(), m.end()) for m in re.finditer(r"\([^()]*\)", flat)]


def _count(read: tuple[str, str, list], name: str | None, office: str | None) -> tuple[int, int, int]:
    text, flat, inside = read
    counts = [0, 0, 0]
    for place, wanted in enumerate((name, office)):
        parts = [p for p in re.findall(r"[^\W_]+", fold_text(wanted or "")) if len(p) > 2 and p not in STOP_WORDS]
        if not parts or any(p not in flat for p in parts):
            continue
        for m in re.finditer(r"\b" + r"\W+(?:\w{1,3}\W+)?".join(map(re.escape, parts)) + r"\b", flat):
            around = next(((a, b) for a, b in inside if a < m.start() < b), None)
            if around:
                counts[2] += bool(re.match(r"[^:()]{0,40}:", flat[m.end() : around[1]]))
            elif place or _HONORIFIC.search(flat[max(0, m.start() - 16) : m.start()]) or (len(parts) > 1 and text[m.start()].isupper()):
                counts[place] += 1
    return counts[0], counts[1], counts[2]


_LINKS = "array<struct<name:string,office:string,weight:double>>"


def _links(text: Column, people: Column) -> Column:
    """The persons (name, office) of an array that the text alludes to, with the points: a text is read once for all."""

    @F.arrow_udf(_LINKS)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        shape = pa.list_(pa.struct([("name", pa.string()), ("office", pa.string()), ("weight", pa.float64())]))
        rows = []
        for t, some in zip(texts, lists, strict=True):
            read = _read(t.as_py()) if t.is_valid and some.is_valid else None
            found = [(p, _weight(*_count(read, p["name"], p["office"]))) for p in some.as_py()] if read else []
            rows.append([{"name": p["name"], "office": p["office"], "weight": w} for p, w in found if w])
        return pa.array(rows, shape)

    return run(text, people)


def _weight(name: int, office: int, interruption: int) -> float:
    more = lambda x: min(EXTRA_CAP, EXTRA * (x - 1))
    n = name + office
    return (((NAME if name else OFFICE) + more(n)) if n else 0.0) + ((INTERRUPTION + more(interruption)) if interruption else 0.0)


def turns(corpus: DataFrame, least: int = 45) -> DataFrame:
    """Substantive turns with their rank in the session: long enough and not of the chair."""
    rows = corpus.filter((F.col("nwords") >= least) & ~role(F.col("speaker")).isin(*_CHAIR))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*KEY).orderBy("ord", "id")))


class _Session:
    """The substantive turns of one session, without their texts."""

    #: Place of a turn without order.
    NOWHERE = 10**6

    def __init__(self, rows: list[dict]):
        at = lambda r: self.NOWHERE if r["ord"] is None else r["ord"]
        self.rows = sorted(rows, key=lambda r: (at(r), r["id"]))
        self.at = [at(r) for r in self.rows]
        self.placed = [r["ord"] for r in self.rows if r["ord"] is not None]
        self.turns: dict = {}  # of a person
        self.named: dict = {}  # turns that allude to a person
        self.links: list[dict] = []
        self.own: dict = {}
        for i, r in enumerate(self.rows):
            self.turns.setdefault((r["name"], r["office"]), []).append(i)
            self.links.append({(x["name"], x["office"]): x["weight"] for x in r["links"] or ()})
            for person in self.links[i]:
                self.named.setdefault(person, []).append(i)
        self.sides: dict = {}

    def same(self, a: dict, b: dict) -> bool:
        if a["rep_id"] is not None and b["rep_id"] is not None:
            return a["rep_id"] == b["rep_id"]
        return a["speaker"] is not None and a["speaker"] == b["speaker"]

    def own_places(self, r: dict) -> list[int]:
        key = r["rep_id"], r["speaker"]
        if key not in self.own:
            self.own[key] = [x["ord"] for x in self.rows if x["ord"] is not None and self.same(r, x)]
        return self.own[key]

    def other_party(self, a: str | None, b: str | None) -> bool:
        return a is not None and b is not None and a != b

    def nearest(self, i: int, top: int) -> set[int]:
        """On each side the next ``top`` turns of others with another party, and with none; of the last place all."""
        r, out = self.rows[i], set()
        if r["party"] not in self.sides:
            split = ([], [])
            for j, o in enumerate(self.rows):
                split[self.other_party(r["party"], o["party"])].append(j)
            self.sides[r["party"]] = [(x, [self.at[j] for j in x]) for x in split]
        for side, places in self.sides[r["party"]]:
            start = bisect_left(places, r["ord"] or 0)
            for way in (range(start, len(side)), range(start - 1, -1, -1)):
                n, last = 0, None
                for k in way:
                    if n >= top and places[k] != last:
                        break
                    if not self.same(r, self.rows[side[k]]):
                        out.add(side[k])
                        n, last = n + 1, places[k]
        return out

    def score(self, i: int, j: int) -> float:
        r, o = self.rows[i], self.rows[j]
        total = 0.0
        for a, b in ((j, r), (i, o)):
            total += self.links[a].get((b["name"], b["office"]), 0.0)
        if r["ord"] is not None and o["ord"] is not None:
            low, high = min(r["ord"], o["ord"]), max(r["ord"], o["ord"])
            between = lambda x: max(0, bisect_left(x, high) - bisect_right(x, low))
            total += TURN * 0.6 ** (between(self.placed) - between(self.own_places(r)))
        return round(total + OTHER_PARTY * self.other_party(r["party"], o["party"]), 1)

    def best(self, top: int):
        for i, r in enumerate(self.rows):
            found = self.nearest(i, top)
            for person in self.links[i]:
                found.update(self.turns.get(person, ()))
            found.update(self.named.get((r["name"], r["office"]), ()))
            rows = []
            for j in found:
                o = self.rows[j]
                if not self.same(r, o) and i != j:
                    rows.append((-self.score(i, j), abs(self.at[j] - (r["ord"] or 0)), -(o["nwords"] or 0), o["id"]))
            for k, (score, _, _, other) in enumerate(heapq.nsmallest(top, rows)):
                yield r["id"], other, -score, k + 1


def synchronic(corpus: DataFrame, top: int = 10) -> DataFrame:
    """(id, other, score, rank): likely replies of the same session, for every substantive turn.

    Allusions are sought by the session's distinct speakers, so a text is read
    once for each, and link turns at any distance. Without one the score only
    falls with distance, so the nearest ``top`` turns on each side, with another
    party and without, hold the best of all others. Only turns of others count
    as turns between.
    """
    office = F.when(role(F.col("speaker")) != "deputy", bare_label(F.col("speaker")))
    t = turns(corpus).withColumns({"name": F.col("rep_name"), "office": office})
    people = F.collect_set(F.struct("name", "office")).over(Window.partitionBy(*KEY))
    t = t.withColumn("links", _links(F.col("speech"), people))
    schema = "id bigint, other bigint, score double, rank int"

    def run(table: pa.Table) -> pa.Table:
        rows = list(_Session(table.to_pylist()).best(top))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["id", "other", "score", "rank"])

    return t.select(*KEY, "id", "ord", "rep_id", "speaker", "party", "nwords", "name", "office", "links").groupBy(*KEY).applyInArrow(run, schema)


def main_terms(corpus: DataFrame, k: int = 12) -> DataFrame:
    """(id, terms): the commonest long tokens of each speech, text in parentheses left out."""
    text = F.regexp_replace(F.coalesce("speech", F.lit("")), r"\([^)]*\)", " ")
    rows = corpus.select("id", F.explode(ascii_tokens(text)).alias("term")).filter((F.char_length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*sorted(STOP_WORDS)))
    counts = rows.groupBy("id", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.col("n").desc(), "term")
    return counts.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def diachronic(corpus: DataFrame, speech_id: int, top: int = 10, least: int = 150) -> DataFrame:
    """(id, relevance, score, rank): earlier and later speeches of the same person on the same matter.

    BM25 of the speech's main terms over the person's long speeches of other
    sessions, scaled to 0..1, times ln(1 + years apart); the ten most alike come
    first. Frequencies are those of the whole corpus.
    """
    me = corpus.filter(F.col("id") == speech_id).select("id", F.col("date").alias("date0"), F.col("num_session").alias("session0"), "rep_id", "speech")
    terms = main_terms(me)
    wanted = terms.select(F.explode("terms").alias("term"))
    tokens = corpus.select("id", F.explode(ascii_tokens(F.col("speech"))).alias("term"))
    tf = tokens.join(F.broadcast(wanted), "term").groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = corpus.select("id", F.size(ascii_tokens(F.col("speech"))).alias("dl"))
    sums = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    mine = corpus.filter((F.col("nwords") >= least) & (F.col("id") != speech_id)).join(F.broadcast(me.select("rep_id", "date0", "session0")), "rep_id").filter(F.col("num_session") != F.col("session0"))
    rows = mine.select("id", "date", "date0").join(tf, "id").join(F.broadcast(df), "term").join(size, "id").crossJoin(F.broadcast(sums))
    scored = rows.groupBy("id", "date", "date0").agg(F.round(F.sum(bm25(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avg"))), 8).alias("bm25"))
    whole = Window.partitionBy(F.lit(0))  # the speeches of one person
    low, high = F.min("bm25").over(whole), F.max("bm25").over(whole)
    rel = F.when(high > low, (F.col("bm25") - low) / (high - low)).otherwise(F.lit(1.0))
    years = years_apart(F.to_date("date"), F.to_date("date0"))
    out = scored.withColumn("relevance", rel).withColumn("score", F.col("relevance") * F.log1p(years))
    out = out.withColumn("alike", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("relevance").desc(), "id")) <= 10)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("alike").desc(), F.round("score", 8).desc(), F.round("relevance", 8).desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("id", "relevance", "score", "rank")
