"""Document parser: a speech as typed blocks with offsets into the original text.

Paragraphs are split on blank lines, page headers left out, broken paragraphs
joined. Each block has a kind (par, turn, stage, list, table, note, head), its
offsets and, for prose and tables, a running number. One long paragraph is cut
at sentence ends into numbered pieces. The rules need look-around over whole
paragraphs, so they run as an Arrow function, one call for a batch of texts.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "array<struct<kind:string,start:int,end:int,number:int,text:string>>"
#: Words of a piece of a long paragraph, and how long one has to be to be cut.
TARGET, LEAST, MOST, TAIL, LONG = 160, 120, 200, 40, 300

_HEADER = re.compile(r"^\s*(?:p[áa]g(?:ina)?\.?\s*\d+|\d{1,4}|[-–—]\s*\d+\s*[-–—]|(?:diario de sesiones|gaceta|journal of debates).{0,80})\s*$", re.I)
_TURN = re.compile(r"^\s*(?:(?:el|la|o|a|the)\s+)?(?:señor|señora|senhor|senhora|sr\.|sra\.|mr\.?|mrs\.?|ms\.?)\s[^:.\n]{2,80}[:.][-–—]?\s", re.I)
_STAGE = re.compile(r"^\s*\([^()]{1,900}\)\s*[.]?\s*$", re.S)
_LIST = re.compile(r"^\s*(?:[-–—•*]|\d{1,3}[.)]|[a-z]\))\s+\S")
_NOTE = re.compile(r"^\s*(?:nota|note)\s*[:.]|^\s*\[\d+\]", re.I)
_SENTENCE = re.compile(r"[.!?…]+[»”\")]*\s+(?=[¿¡«“\"(]?[A-ZÁÉÍÓÚÑÜÀÂÊÔÇ0-9])")
_OPEN_END = re.compile(r"(?:[,;:]|\b(?:de|la|el|que|y|en|a|los|las|of|the|and|to|in))\s*$", re.I)


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Offsets of paragraphs, broken ones joined, page headers left out."""
    found = []
    for m in re.finditer(r"\S(?:.*?\S)?(?=\s*\n\s*\n|\s*\Z)", text, re.S):
        if not _HEADER.match(m.group()):
            found.append(m.span())
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out:
            before = text[out[-1][0] : out[-1][1]]
            unfinished = before.endswith("-") or _OPEN_END.search(before) or before.count("(") > before.count(")")
            if unfinished and (text[a].islower() or before.count("(") > before.count(")")):
                out[-1] = out[-1][0], b
                continue
        out.append((a, b))
    return out


def kind(text: str) -> str:
    """Kind of one paragraph."""
    lines = [x for x in text.split("\n") if x.strip()]
    letters = [c for c in text if c.isalpha()]
    if _STAGE.match(text):
        return "stage"
    if _TURN.match(text):
        return "turn"
    if _NOTE.match(text):
        return "note"
    if len(lines) > 1 and sum(bool(re.search(r"\S {2,}\S|\t|\s\|\s", x)) for x in lines) > len(lines) / 2:
        return "table"
    if sum(bool(_LIST.match(x)) for x in lines) > len(lines) / 2:
        return "list"
    if 0 < len(letters) <= 120 and len(lines) == 1 and sum(c.isupper() for c in letters) >= 0.85 * len(letters) and not text.rstrip().endswith("."):
        return "head"
    return "par"


def pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A long paragraph cut at sentence ends near the target length; a short tail joins the last piece."""
    cuts = [a + m.end() for m in _SENTENCE.finditer(text[a:b])]
    ends = [*cuts, b]
    # cuts stand behind white space, so the words up to one are a running sum
    words = list(accumulate(len(text[x:y].split()) for x, y in zip([a, *cuts], ends, strict=True)))
    out, start, before = [], a, 0
    for i, end in enumerate(ends):
        n = words[i] - before
        more = words[min(i + 1, len(ends) - 1)] - before
        rest = words[-1] - words[i]
        if (n >= TARGET or (n >= LEAST and more > MOST)) and rest >= TAIL:
            out.append((start, end))
            start, before = end, words[i]
    out.append((start, b))
    return out


def repair(text: str) -> str:
    """Soft hyphens and words split at a line end put right, for display."""
    text = text.replace("­", "")
    return re.sub(r"(?<=[a-záéíóúñü])-\n(?=[a-záéíóúñü])", "", text)


def parse(text: str | None) -> list[dict]:
    """Blocks of one speech; an empty or null text has none."""
    spans = paragraphs(text or "")
    if len(spans) == 1 and len((text or "").split()) > LONG:
        spans = pieces(text, *spans[0])
    out, number = [], 0
    for a, b in spans:
        k = kind(text[a:b])
        counted = k in ("par", "turn", "table", "list")
        number += counted
        out.append({"kind": k, "start": a, "end": b, "number": number if counted else None, "text": repair(text[a:b])})
    return out


def blocks(text: Column) -> Column:
    @F.arrow_udf(BLOCK)
    def run(texts: pa.Array) -> pa.Array:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("number", pa.int32()), ("text", pa.string())]))
        return pa.array([parse(t) for t in texts.to_pylist()], shape)

    return run(text)


def documents(corpus: DataFrame) -> DataFrame:
    """(id, kind, start, end, number, text) of every block."""
    return corpus.select("id", F.explode(blocks(F.col("speech"))).alias("b")).select("id", "b.*")


def speech_only(corpus: DataFrame) -> DataFrame:
    """The corpus with prose and turns alone as text, stage directions inside them left out."""
    kept = F.filter(blocks(F.col("speech")), lambda b: b["kind"].isin("par", "turn"))
    prose = F.array_join(F.transform(kept, lambda b: F.regexp_replace(b["text"], r"\([^()]{1,900}\)", " ")), "\n\n")
    return corpus.withColumn("speech", prose)


def plain_text(parsed: DataFrame) -> DataFrame:
    """(id, text): numbered paragraphs, one a line."""
    line = F.concat(F.lit("§"), F.col("number"), F.lit(" "), F.col("text"))
    rows = parsed.filter("number IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("x"))
    return rows.select("id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
