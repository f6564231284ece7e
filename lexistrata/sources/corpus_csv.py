"""CSV corpus source: checks of the file, typed errors, derived columns, dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import year_of
from ..functions.ranking import cut, numbered
from ..functions.text import word_count
from ..schema import CORPUS, CSV_COLUMNS, UNKNOWN
from ..session import ship
from . import csv_ranges


class IngestError(ValueError):
    """A file that can't be a corpus; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _file(spark: SparkSession, path: str):
    """Hadoop file system and path."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def sniff(spark: SparkSession, path: str) -> list[str]:
    """Looks at the head of a file; raises on what is no CSV, returns warnings."""
    fs, file = _file(spark, path)
    stream = fs.open(file)
    try:
        data = bytes(stream.readNBytes(4096))
    finally:
        stream.close()
    if not data:
        raise IngestError("empty_file")
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        raise IngestError("zip_file")
    if data.startswith(b"SQLite format 3"):
        raise IngestError("sqlite_file")
    if b"\x00" in data:
        raise IngestError("nul_byte")
    line = data.removeprefix(b"\xef\xbb\xbf").split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r")
    names = [x.strip().strip('"') for x in line.split(",")]
    if len(names) == 1:
        for sep in ";\t|":
            if len(line.split(sep)) > 1:
                raise IngestError("wrong_separator", sep)
    if len(line) > 4000:
        raise IngestError("long_header")
    if tuple(names) != CSV_COLUMNS:
        raise IngestError("wrong_header", ",".join(names)[:200])
    return ["bom"] if data.startswith(b"\xef\xbb\xbf") else []


def _numbered(found: DataFrame) -> DataFrame:
    """All columns as strings, empty ones null; ``width`` and the place of each record; the header is left out."""
    at = {c: F.try_element_at("fields", F.lit(k + 1)) for k, c in enumerate(CSV_COLUMNS)}
    rows = found.filter("number > 0").select("number", "line", "byte", F.size("fields").alias("width"), *(F.when(v != "", v).alias(c) for c, v in at.items()))
    return rows.withColumn("place", F.col("number"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file, read in ranges of bytes: all columns as strings, ``width``, ``line`` from 1, ``byte`` from 0, and ``place``, the order in the file."""
    source = csv_ranges.lines(spark, path)
    return _numbered(csv_ranges.read(source, csv_ranges.survey(source)))


_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
#: What ends the ingest, in order; the rest are warnings.
FATAL = ("field_count", "order_not_integer", "order_too_long", "order_out_of_range", "flag_not_integer")


def problems(raw: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """(code, n, number, line, byte, value): what is wrong with the records, how many of them, and the first one.

    Failures: ``field_count``; an order that is no integer, has more than 4,300
    digits or doesn't fit 32 bits; a speech flag that is no integer. Warnings:
    ``blank_line``, ``bad_date``, and, if ``parties`` (label) is given,
    ``unknown_party``.
    """
    digits = lambda c: F.regexp_replace(F.btrim(F.col(c)), "[_+-]", "")
    whole = lambda c: F.col(c).rlike(_INTEGER)
    fits = F.regexp_replace(F.btrim("intervention_order"), "_", "").try_cast("int").isNotNull()
    full = F.col("width") == len(CSV_COLUMNS)
    order = full & F.col("intervention_order").isNotNull()
    checks = {
        "blank_line": (F.col("width") == 0, F.lit(None)),
        "field_count": (~full & (F.col("width") > 0), F.col("width").cast("string")),
        "order_not_integer": (order & ~whole("intervention_order"), F.col("intervention_order")),
        "order_too_long": (order & whole("intervention_order") & (F.length(digits("intervention_order")) > 4300), F.lit(None)),
        "order_out_of_range": (order & whole("intervention_order") & (F.length(digits("intervention_order")) <= 4300) & ~fits, F.col("intervention_order")),
        "flag_not_integer": (full & F.col("dm_speech").isNotNull() & ~whole("dm_speech"), F.col("dm_speech")),
        "bad_date": (full & (F.btrim(F.coalesce("date", F.lit(""))) != "") & F.try_to_timestamp(F.btrim("date"), F.lit("yyyy-MM-dd")).isNull(), F.col("date")),
    }
    if parties is not None:
        known = parties.select(F.col("label").alias("party")).distinct().withColumn("known", F.lit(True))
        raw = raw.withColumn("party", F.btrim("party")).join(known, "party", "left")
        checks["unknown_party"] = (full & (F.coalesce("party", F.lit("")) != "") & F.col("known").isNull(), F.col("party"))
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(k).alias("code"), v.cast("string").alias("value"))) for k, (c, v) in checks.items())), lambda x: x.isNotNull())
    each = raw.select("number", "line", "byte", F.explode(found).alias("f"))
    first = F.min(F.struct("number", "line", "byte", "f.value")).alias("at")
    return each.groupBy("f.code").agg(F.count("*").alias("n"), first).select("code", "n", "at.number", "at.line", "at.byte", "at.value")


def _first_seen(rows: DataFrame, key: str, name: str, first: int) -> DataFrame:
    """(key, name): numbers of keys by first appearance."""
    firsts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("place").alias("p"))
    return numbered(firsts, ["p"], name, first).select(key, name)


def transform(raw: DataFrame) -> DataFrame:
    """Corpus rows of raw records."""
    clean = lambda c: F.when(F.btrim(F.coalesce(c, F.lit(""))) == "", F.lit(None)).otherwise(F.btrim(c))
    known = lambda c: F.coalesce(clean(c), F.lit(UNKNOWN))
    c = F.col
    rows = raw.filter(F.col("width") == len(CSV_COLUMNS))
    rows = rows.withColumn("id_session", F.btrim("id_session")).withColumn("id_dep", clean(c("id_dep")))
    rows = numbered(rows, ["place"], "id", 1)
    rows = rows.join(_first_seen(rows, "id_session", "num_session", 1), "id_session", "left").join(_first_seen(rows, "id_dep", "rep_id", 0), "id_dep", "left")
    order = F.regexp_replace(F.btrim("intervention_order"), "_", "").try_cast("int")
    label = F.coalesce(clean(c("speaker_raw")), F.when(F.coalesce(order, F.lit(0)) == 0, "SUMARIO").otherwise("COMENTARIOS"))
    speech = F.coalesce(F.btrim("dm_speech").try_cast("int"), F.when(clean(c("speaker_raw")).isNull(), 0).otherwise(1))
    date = clean(c("date"))
    return rows.select(
        c("id"), "id_int", "id_session", c("num_session").cast("int"), clean(c("session_number")).alias("session_number"), order.alias("ord"), date.alias("date"), year_of(date).alias("year"),
        known(c("legislature")).alias("legislature"), known(c("legislative_session")).alias("legislative_session"), known(c("session_type")).alias("session_type"), label.alias("speaker"),
        c("rep_id").cast("int"), "id_dep", known(c("speaker_name")).alias("rep_name"), F.upper(known(c("sex"))).alias("sex"), known(c("district")).alias("district"), known(c("party")).alias("party"),
        speech.alias("dm_speech"), word_count(c("text")).alias("nwords"), F.octet_length(F.coalesce("text", F.lit(""))).alias("nbytes"), F.coalesce("text", F.lit("")).alias("speech"),
    ).select(*CORPUS.fieldNames())


def examine(spark: SparkSession, path: str, parties: DataFrame | None = None) -> tuple[DataFrame, list[tuple]]:
    """The raw records of a file, and warnings (code, n, number, line); raises ``IngestError`` on a file that can't be a corpus."""
    ship(spark)
    warnings = [(w, 1, 0, 1) for w in sniff(spark, path)]
    source = csv_ranges.lines(spark, path)
    plan = csv_ranges.survey(source)
    if plan.nul:
        raise IngestError("nul_byte", f"line {plan.nul[0]}, byte {plan.nul[1]}")
    if plan.bad:
        raise IngestError("cut_utf8" if plan.bad_cut else "invalid_utf8", f"line {plan.bad[0]}, byte {plan.bad[1]}")
    raw = cut(_numbered(csv_ranges.read(source, plan)))
    if plan.cut:
        last = raw.agg(F.max(F.struct("number", "line")).alias("m")).first().m
        raise IngestError("cut_in_quotes", f"record {last.number}, line {last.line}" if last else "in the header")
    found = {r.code: r for r in problems(raw, parties).collect()}
    for code in FATAL:
        if code in found:
            r = found[code]
            raise IngestError(code, f"{r.n} records, the first {r.number} in line {r.line} at byte {r.byte}" + (f": {r.value[:80]}" if r.value else ""))
    return raw, warnings + [(r.code, r.n, r.number, r.line) for r in sorted(found.values(), key=lambda r: r.code)]


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Corpus of one CSV file; raises ``IngestError`` on a file that can't be one."""
    return transform(examine(spark, path)[0])


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Parquet by year, sorted inside files as sessions are read."""
    corpus.repartition("year", F.pmod(F.xxhash64("id_session"), F.lit(32))).sortWithinPartitions("date", "num_session", "ord", "id").write.mode("overwrite").partitionBy("year").parquet(path)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, each read as a stream, whatever its size."""
    fs, pattern = _file(spark, path)
    rows = []
    for status in fs.globStatus(pattern):
        stream = fs.open(status.getPath())
        try:
            rows.append((str(status.getPath()), status.getLen(), spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return spark.createDataFrame(rows, "path string, length long, sha256 string")
