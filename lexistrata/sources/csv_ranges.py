"""CSV records from byte ranges read in parallel.

The text source deals a file out at line feeds. A line begins either a record or
lies inside quotes, so a first pass reads each range both ways and keeps, for
each way, how it ends; going through the ranges in order (one row each) tells
which way was the true one. The second pass reads each range that way. Records
that lie over range ends leave pieces, which are joined for each record. Places
of records and bytes are exact, as lines are kept byte for byte.

Records are those of Python's ``csv`` reader: fields may hold line breaks inside
quotes, a quote inside a field without quotes is a character, a line ends at CR,
LF or both, and a blank line is a record without fields.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, value): the file's lines as bytes, without line feeds; a range's lines come together and in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


class _Source:
    """Pieces of a range for the csv reader, cut at CR and LF as it wants them; knows if it was asked for more than there is."""

    def __init__(self, raw: list[bytes], quoted: bool, last: bool):
        self.pieces: list[bytes] = []
        for k, line in enumerate(raw):
            self.pieces += (line if last and k == len(raw) - 1 else line + b"\n").splitlines(keepends=True)
        self.quoted, self.spent, self.at = quoted, False, 0

    def __iter__(self) -> Iterator[str]:
        for k, piece in enumerate(self.pieces):
            self.at = k + 1
            text = piece.decode("utf-8", "surrogateescape")
            yield '"' + text if self.quoted and k == 0 else text
        self.spent = True


def records(raw: list[bytes], quoted: bool, last: bool = False) -> Iterator[tuple[list[str], int, int, bool]]:
    """(fields, first piece, piece after, open) of each record; ``quoted``: the first line goes on inside quotes.

    The last one is open if the range ends inside its quotes.
    """
    csv.field_size_limit(sys.maxsize)
    source = _Source(raw, quoted, last)
    start = 0
    for fields in csv.reader(iter(source)):
        yield fields, start, source.at, source.spent
        start = source.at


def _ends(raw: list[bytes], quoted: bool, last: bool) -> tuple[int, bool]:
    """Records that a range closes, and whether it ends inside quotes."""
    closed, open_ = 0, False
    for _, _, _, open_ in records(raw, quoted, last):
        closed += not open_
    return closed, open_


def _blocks(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Each range with its lines. A range is what the session's split size makes it."""
    block, held = None, []
    for batch in batches:
        for b, value in zip(batch.column("block").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if b != block and held:
                yield block, held
                held = []
            block = b
            held.append(value)
    if held:
        yield block, held


_SURVEY = "block long, lines long, bytes long, plain long, plain_open boolean, quoted long, quoted_open boolean, nul_line long, nul_byte long, bad_line long, bad_byte long, bad_cut boolean"


def _survey(batches) -> Iterator[pa.RecordBatch]:
    for block, raw in _blocks(batches):
        out = {"block": block, "lines": len(raw), "bytes": sum(map(len, raw)) + len(raw), "nul_line": None, "nul_byte": None, "bad_line": None, "bad_byte": None, "bad_cut": None}
        at = 0
        for k, line in enumerate(raw):
            if out["nul_line"] is None and (p := line.find(b"\x00")) >= 0:
                out |= {"nul_line": k, "nul_byte": at + p}
            if out["bad_line"] is None:
                try:
                    line.decode()
                except UnicodeDecodeError as e:
                    out |= {"bad_line": k, "bad_byte": at + e.start, "bad_cut": e.reason == "unexpected end of data" and k == len(raw) - 1}
            at += len(line) + 1
        # whether the file ends with a line feed makes no difference to what follows
        for name, quoted in (("plain", False), ("quoted", True)):
            out[name], out[f"{name}_open"] = _ends(raw, quoted, False)
        yield pa.RecordBatch.from_pylist([out], schema=_schema(_SURVEY))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


@dataclass
class Plan:
    """What the first pass found, a range at a time in order: entries, first numbers of records, lines and bytes, and who owns what it starts with."""

    quoted: dict[int, bool] = field(default_factory=dict)
    owner: dict[int, int] = field(default_factory=dict)
    first: dict[int, int] = field(default_factory=dict)
    line: dict[int, int] = field(default_factory=dict)
    byte: dict[int, int] = field(default_factory=dict)
    records: int = 0
    bytes: int = 0
    #: the file ends inside quotes
    cut: bool = False
    #: (line from 1, byte from 0) of the first of each
    nul: tuple[int, int] | None = None
    bad: tuple[int, int] | None = None
    #: the invalid bytes are the beginning of a letter at the very end
    bad_cut: bool = False


def survey(source: DataFrame) -> Plan:
    """The first pass. One row for each range comes to the driver."""
    rows = sorted(source.mapInArrow(_survey, _SURVEY).collect(), key=lambda r: r.block)
    plan = Plan()
    quoted, line, owner = False, 0, None
    for k, r in enumerate(rows):
        b = r.block
        plan.quoted[b], plan.first[b], plan.line[b], plan.byte[b] = quoted, plan.records, line, plan.bytes
        if r.nul_line is not None and plan.nul is None:
            plan.nul = line + r.nul_line + 1, plan.bytes + r.nul_byte
        if r.bad_line is not None and plan.bad is None:
            plan.bad = line + r.bad_line + 1, plan.bytes + r.bad_byte
            plan.bad_cut = bool(r.bad_cut) and k == len(rows) - 1
        if quoted:
            plan.owner[b] = owner
        closed, open_ = (r.quoted, r.quoted_open) if quoted else (r.plain, r.plain_open)
        # a range that closes no record and began inside quotes only carries the record on
        if open_ and not (quoted and closed == 0):
            owner = b
        plan.records += closed
        quoted, line, plan.bytes = open_, line + r.lines, plan.bytes + r.bytes
    plan.cut = quoted
    plan.records += quoted
    return plan


_RECORD = "number long, line long, byte long, fields array<string>, block long, piece binary, head boolean"


def _read(batches, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Whole records, and pieces of those that lie over range ends: ``block`` and ``piece`` with the place of the record in its first piece."""
    schema, most = _schema(_RECORD), 4 << 20
    for block, raw in _blocks(batches):
        source = _Source(raw, False, False)
        sizes = [len(p) for p in source.pieces]
        number, at, line, k = plan.first[block], plan.byte[block], plan.line[block] + 1, 0
        out, held = [], 0
        for j, (fields, a, b, open_) in enumerate(records(raw, plan.quoted[block])):
            size = sum(sizes[a:b])
            head = plan.quoted[block] and j == 0
            row = {"number": number, "line": line, "byte": at, "fields": None if open_ or head else fields, "block": block, "piece": b"".join(source.pieces[a:b]) if open_ or head else None, "head": head}
            out.append(row)
            number += not open_
            at += size
            held += size
            line += sum(p.endswith(b"\n") for p in source.pieces[a:b])
            k += 1
            if held > most:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _joined(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            raw = b"".join(p["piece"] for p in r["pieces"])
            fields, *_ = next(records([raw], False, True))
            out.append({"number": r["number"], "line": r["line"], "byte": r["byte"], "fields": fields, "block": r["block"], "piece": None, "head": False})
        yield pa.RecordBatch.from_pylist(out, schema=_schema(_RECORD))


def read(source: DataFrame, plan: Plan) -> DataFrame:
    """(number, line, byte, fields): every record of the file with its number from 0, its line from 1 and its first byte."""
    spark = source.sparkSession
    rows = source.mapInArrow(lambda b: _read(b, plan), _RECORD)
    whole = rows.filter("piece IS NULL").select("number", "line", "byte", "fields")
    if not plan.owner and not plan.cut:
        return whole
    # a row for each range that begins inside quotes
    owners = spark.createDataFrame(list(plan.owner.items()) or [(-1, -1)], "block long, owner long")
    pieces = rows.filter("piece IS NOT NULL").join(owners, "block", "left")
    # the piece that a range ends with is its own; the one that it begins with, or is, belongs to the owner
    pieces = pieces.withColumn("owner", F.when(F.col("head"), F.col("owner")).otherwise(F.col("block")))
    grouped = pieces.groupBy("owner").agg(F.min(F.struct("byte", "line", "number")).alias("start"), F.array_sort(F.collect_list(F.struct("byte", "piece"))).alias("pieces"))
    joined = grouped.select("start.number", "start.line", "start.byte", F.col("owner").alias("block"), "pieces").mapInArrow(_joined, _RECORD)
    return whole.unionByName(joined.select("number", "line", "byte", "fields"))


# --- change detection --------------------------------------------------------

_SIZE = 1 << 256


def _chunks(batches, plan_bytes: dict[int, int], size: int) -> Iterator[pa.RecordBatch]:
    """(chunk, part) of each range: sums of the hashes of the lines that begin in a chunk, each with its place in it."""
    from hashlib import sha256

    for block, raw in _blocks(batches):
        at, sums = plan_bytes[block], {}
        for line in raw:
            chunk, place = divmod(at, size)
            sums[chunk] = (sums.get(chunk, 0) + int.from_bytes(sha256(place.to_bytes(8, "big") + line).digest(), "big")) % _SIZE
            at += len(line) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.to_bytes(32, "big") for v in sums.values()], pa.binary())], ["chunk", "part"])


def _added(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [sum(int.from_bytes(p, "big") for p in parts) % _SIZE for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([format(v, "064x") for v in sums])], ["chunk", "hash"])


def chunk_hashes(spark: SparkSession, path: str, size: int = 8 << 20) -> DataFrame:
    """(level, chunk, hash): of the file's chunks of ``size`` bytes at level 0, and of the tree over them, 256 to a node.

    A line counts in the chunk in which it begins. The hash of a chunk is the sum
    of its lines' hashes modulo 2**256, so it is the same however the file was
    dealt out. The last level has one row.
    """
    source = lines(spark, path)
    counted = source.mapInArrow(_sizes, "block long, bytes long").collect()  # a row for each range
    starts, at = {}, 0
    for r in sorted(counted, key=lambda r: r.block):
        starts[r.block] = at
        at += r.bytes
    parts = source.mapInArrow(lambda b: _chunks(b, starts, size), "chunk long, part binary")
    level = parts.groupBy("chunk").agg(F.collect_list("part").alias("parts")).mapInArrow(_added, "chunk long, hash string")
    out, k, n = level.withColumn("level", F.lit(0)), 0, -(-at // size)
    while n > 1:
        k, n = k + 1, -(-n // 256)
        level = level.groupBy(F.floor(F.col("chunk") / 256).alias("up")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("chunk", "hash")))), 256).alias("hash")).withColumnRenamed("up", "chunk")
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "chunk", "hash")


def _sizes(batches) -> Iterator[pa.RecordBatch]:
    for block, raw in _blocks(batches):
        yield pa.RecordBatch.from_pylist([{"block": block, "bytes": sum(map(len, raw)) + len(raw)}])


def changed_chunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(chunk, kind): chunks that are ``added``, ``removed`` or ``changed``; subtrees with equal hashes aren't entered."""
    one, two = before.withColumnRenamed("hash", "old"), after.withColumnRenamed("hash", "new")
    top = max(r.m or 0 for x in (before, after) for r in x.agg(F.max("level").alias("m")).collect())
    open_ = None
    for level in range(top, -1, -1):
        pairs = one.filter(F.col("level") == level).drop("level").join(two.filter(F.col("level") == level).drop("level"), "chunk", "full_outer")
        if open_ is not None:
            pairs = pairs.join(open_, F.floor(F.col("chunk") / 256) == F.col("parent"), "left_semi")
        unlike = pairs.filter(~F.col("old").eqNullSafe(F.col("new")))
        open_ = unlike.select(F.col("chunk").alias("parent"))
    return unlike.select("chunk", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("kind"))
