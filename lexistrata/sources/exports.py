"""Sinks: CSV, JSON, Markdown, references, GEXF, and library bundles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_markup, guard_formula, slug

#: Fixed value: the format tag by which bundles are told.
BUNDLE = "2replib/1"
#: Bytes of a row beside its text, and how much longer the text gets.
ROW_BYTES = {"csv": 143, "json": 446.09, "markdown": 191, "citations": 178, "bundle": 191}
TEXT_FACTOR = {"csv": 1.003, "json": 1.02, "markdown": 1.0015, "citations": 0.0, "bundle": 0.0}
#: Fixed value: bytes of a JSON export beside its rows.
JSON_NOTICE = 647.6


def rows_for(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Corpus rows for (k, id) in the requested order, repeated ids repeated."""
    return ids.join(corpus, "id")


def citation(c: DataFrame | None = None) -> Column:
    """One line for a speech: speaker, party, date, session, source id."""
    return F.concat_ws(", ", "rep_name", F.concat(F.lit("("), F.col("party"), F.lit(")")), "date", F.concat(F.lit("session "), F.col("num_session").cast("string")), F.concat(F.lit("id "), F.col("id").cast("string")))


#: A file that begins with it is read as UTF-8 by spreadsheets.
BOM = "\ufeff"


def csv_lines(rows: DataFrame, columns: list[str], source: str, cited: dict[str, str] | None = None, bom: bool = False) -> DataFrame:
    """(line) with every cell quoted, ``;`` between, formula cells guarded; first lines cite the source.

    ``cited`` adds columns with the same value in each row, such as the source's
    citation and DOI. Arrays are joined by commas. ``bom`` marks the first line.
    """
    cited = cited or {}
    arrays = [c for c, kind in rows.dtypes if kind.startswith("array") and c in columns]
    rows = rows.withColumns({c: F.array_join(c, ", ") for c in arrays} | {c: F.lit(v) for c, v in cited.items()})
    columns, source = [*columns, *cited], (BOM if bom else "") + "# " + source
    cell = lambda c: F.concat(F.lit('"'), F.replace(guard_formula(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))
    body = rows.select(F.col("k").alias("k"), F.concat_ws(";", *map(cell, columns)).alias("line"))
    head = [(-2, source), (-1, ";".join(f'"{c}"' for c in columns))]
    return rows.sparkSession.createDataFrame(head, "k long, line string").unionByName(body.withColumn("k", F.col("k").cast("long")))


def write_csv(lines: DataFrame, path: str) -> None:
    """Lines in order with CRLF ends, in files that follow each other."""
    lines.orderBy("k").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def json_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("k", F.to_json(F.struct(*columns)).alias("line"))


def markdown(rows: DataFrame, text: bool = True) -> DataFrame:
    """(k, line): a heading, its metadata and the text of each speech."""
    parts = [F.concat(F.lit("## "), F.col("rep_name")), F.lit(""), F.concat(F.lit("*"), citation(), F.lit("*")), F.lit("")]
    if text:
        parts += [F.regexp_replace("speech", r"(?m)^([#>*-])", r"\\$1"), F.lit("")]
    return rows.select("k", F.concat_ws("\n", *parts).alias("line"))


def bibtex(rows: DataFrame) -> DataFrame:
    key = F.concat_ws("-", slug(F.col("rep_name")), F.coalesce("year", F.lit(0)).cast("string"), F.col("id").cast("string"))
    line = F.concat(F.lit("@misc{"), key, F.lit(",\n  author = {"), F.col("rep_name"), F.lit("},\n  year = {"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("},\n  note = {"), citation(), F.lit("}\n}"))
    return rows.select("k", line.alias("line"))


def ris(rows: DataFrame) -> DataFrame:
    line = F.concat_ws("\n", F.lit("TY  - HEAR"), F.concat(F.lit("AU  - "), F.col("rep_name")), F.concat(F.lit("DA  - "), F.coalesce("date", F.lit(""))), F.concat(F.lit("N1  - "), citation()), F.lit("ER  - "))
    return rows.select("k", line.alias("line"))


def estimate(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """(rows, words, text_bytes, and bytes for each format) of an export, before it is made."""
    size = lambda k: F.round(F.sum("nbytes") * TEXT_FACTOR[k] + F.count("*") * ROW_BYTES[k] + (JSON_NOTICE if k == "json" else 0)).cast("long").alias(f"{k}_bytes")
    return corpus.join(ids.select("id"), "id", "left_semi").agg(F.count("*").alias("rows"), F.sum("nwords").alias("words"), F.sum("nbytes").alias("text_bytes"), *map(size, ROW_BYTES))


def gexf(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> str:
    """GEXF text of a drawn network (nodes: id, label; edges: a, b, weight); drawings have at most thousands of nodes."""
    n = nodes.select(F.concat(F.lit('<node id="'), escape_markup(F.col("id").cast("string")), F.lit('" label="'), escape_markup(F.col("label")), F.lit('"/>')).alias("x"), "id").orderBy("id").collect()
    e = edges.select(F.concat(F.lit('<edge source="'), escape_markup(F.col("a").cast("string")), F.lit('" target="'), escape_markup(F.col("b").cast("string")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("x"), "a", "b").orderBy("a", "b").collect()
    kind = "directed" if directed else "undirected"
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', f'<graph defaultedgetype="{kind}">', "<nodes>", *(r.x for r in n), "</nodes>", "<edges>", *(r.x for r in e), "</edges>", "</graph>", "</gexf>"])


def bundle(collection: dict, items: DataFrame, corpus: DataFrame, country: str) -> str:
    """A collection as one JSON document; its items carry enough to be recognised."""
    keys = corpus.select("id", "date", "rep_name", "speaker")
    rows = items.join(keys, "id").orderBy("position").select(F.to_json(F.struct(F.col("id").alias("speech_id"), "note", "tags", "date", "rep_name", "speaker"), {"ignoreNullFields": "false"}).alias("j")).collect()
    return json.dumps({"format": BUNDLE, "corpus": country, "collection": collection, "items": [json.loads(r.j) for r in rows]}, ensure_ascii=False, indent=2)


def read_bundle(spark: SparkSession, text: str, country: str) -> tuple[dict, DataFrame]:
    """(collection, items) of a bundle; everything is checked before anything is returned."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError("no JSON") from e
    if not isinstance(data, dict) or data.get("format") != BUNDLE:
        raise ValueError("not a bundle of this format")
    if data.get("corpus") != country:
        raise ValueError(f"the bundle is of {data.get('corpus')}, the corpus of {country}")
    items = data.get("items")
    if not isinstance(items, list) or not all(isinstance(i, dict) and isinstance(i.get("speech_id"), int) for i in items):
        raise ValueError("an item has no speech_id")
    name = str(data.get("collection", {}).get("name", "")) or "collection"
    rows = [(i["speech_id"], i.get("note") or "", [str(t) for t in i.get("tags") or []], k) for k, i in enumerate(items)]
    return {"name": f"{name} (imported)"}, spark.createDataFrame(rows, "id long, note string, tags array<string>, position int")


def csl(rows: DataFrame, corpus: str = "", url: str = "") -> DataFrame:
    """(k, line): each speech as an item of CSL-JSON, a ``speech`` with its author in family and given name, its date in parts, and the session as the event."""
    comma = F.contains("rep_name", F.lit(","))
    words = F.split(F.btrim("rep_name"), r"\s+")
    family = F.when(comma, F.btrim(F.split_part("rep_name", F.lit(","), F.lit(1)))).otherwise(F.element_at(words, -1))
    given = F.when(comma, F.btrim(F.split_part("rep_name", F.lit(","), F.lit(2)))).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    author = F.struct(family.alias("family"), F.when(given != "", given).alias("given"))
    # months and days are numbers; a date that is only a year has one part
    parts = F.transform(F.split("date", "-"), lambda x: x.cast("int"))
    item = F.struct(
        F.concat_ws("-", slug(F.col("rep_name")), F.coalesce("year", F.lit(0)).cast("string"), F.col("id").cast("string")).alias("id"), F.lit("speech").alias("type"), F.array(author).alias("author"),
        F.when(F.col("date").isNotNull(), F.struct(F.array(parts).alias("date-parts"))).alias("issued"), F.concat(F.lit("session "), F.col("num_session").cast("string")).alias("event-title"),
        F.col("id").cast("string").alias("number"), F.lit(corpus or None).cast("string").alias("container-title"), F.lit(url or None).cast("string").alias("URL"),
    )
    return rows.select("k", F.to_json(item).alias("line"))
