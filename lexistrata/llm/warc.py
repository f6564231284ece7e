"""WARC archives with a two-level capture index.

Archives: one gzip member per record, files of a bounded size, written where the
rows are. Index: lines ``reversed-host key, id, file, offset, length`` sorted by
key over all files and cut into compressed blocks; each index file ends with a
sparse directory of the first key of each block, and a list of index files has
the first key of each. A lookup binary-searches the list, then the directory,
then the block, and reads one range of one archive.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, materialise, partitions, scratch, ship

_MAGIC = b"LXINDEX1"
_DATE = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Settings:
    #: Payloads of fewer bytes are never revisits.
    least_bytes: int = 100
    #: Rows of one large group of equal payloads are dealt out over so many keys.
    salts: int = 64
    file_bytes: int = 256 << 20
    block_lines: int = 512
    level: int = 3


def surt(url: str | None) -> str:
    """Sort key of a URL: reversed host labels, then port, path and query."""
    scheme, sep, rest = (url or "").partition("://")
    if not sep:
        return f"-){url or ''}"
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].partition(":")
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:].partition("#")[0] or "/")


def record(kind: str, url: str | None, page: int | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record; a revisit carries no payload but names its length, digest and original."""
    clean = lambda s: "".join(c for c in s if c >= " ")
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean(url or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != size + 4:
        raise ValueError("damaged WARC record")
    return fields, rest[:size]


def write(pages: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, str]:
    """Writes the archives; returns capture lines and the folder.

    The first of each group of equal payloads comes from the digests alone; the
    payloads are shuffled once, by digest and a salt.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    groups = rows.filter(F.col("size") >= settings.least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups.select("digest", "first"), "groups")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(settings.salts)).cast("int")
    # payloads too short for a revisit get keys of their own, or they would share one
    key = F.when(F.col("size") >= settings.least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    left = rows.withColumns({"key": key, "salt": salt})
    right = groups.select(F.col("digest").alias("key"), "first", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))).alias("salt"))
    joined = left.join(right, ["key", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = joined.select("page_id", "url", "payload", "digest", refers.alias("refers"))

    def run(batches):
        import uuid

        fs, root = file_system(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for r in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "response" if r["refers"] is None else "revisit"
                    raw = record(kind, r["url"], r["page_id"], r["payload"], r["digest"], r["refers"])
                    deflate = zlib.compressobj(settings.level, zlib.DEFLATED, 31)
                    data = deflate.compress(raw) + deflate.flush()
                    out.write(data)
                    lines.append((surt(r["url"]), r["page_id"], name, at, len(data)))
                    at += len(data)
                    if at >= settings.file_bytes:
                        out.close()
                        out = None
                cols = list(zip(*lines, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    captures = materialise(joined.mapInArrow(run, "key string, page_id long, file string, start long, length long"), "captures")
    return captures, folder


def index(captures: DataFrame, folder: str, settings: Settings = Settings()) -> list[tuple]:
    """Writes the index files; returns (first key, page_id, file, size) of each, in order.

    There is one file for each range partition, so the list is bounded by their number.
    """
    spark = captures.sparkSession
    order = ["key", F.col("page_id").asc_nulls_first()]
    lines = captures.repartitionByRange(partitions(spark), *order, "file", "start").sortWithinPartitions(*order, "file", "start")

    def run(batches):
        import uuid

        fs, root = file_system(folder)
        name, out, at, directory, held, first = f"{uuid.uuid4().hex}.index", None, 0, [], [], None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "start", "length")), strict=True):
                held.append(r)
                if len(held) == settings.block_lines:
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    data = zlib.compress(json.dumps(held).encode(), 3)
                    directory.append([held[0][0], held[0][1], at, len(data)])
                    out.write(data)
                    at, held = at + len(data), []
        if held:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress(json.dumps(held).encode(), 3)
            directory.append([held[0][0], held[0][1], at, len(data)])
            out.write(data)
            at += len(data)
        if directory:
            tail = zlib.compress(json.dumps(directory).encode(), 3)
            out.write(tail + struct.pack("<Q", len(tail)) + _MAGIC)
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_pylist([{"key": first[0], "page_id": first[1], "file": name, "size": at + len(tail) + 16}], schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("size", pa.int64())]))

    files = materialise(lines.mapInArrow(run, "key string, page_id long, file string, size long"), "index")
    return sorted(((r.key, _number(r.page_id), r.file, r.size) for r in files.collect()))


def _number(page: int | None) -> tuple:
    """Sorts a null id first."""
    return (page is not None, page or 0)


class Index:
    """Reader of the two levels; keeps the last directory and the last block."""

    def __init__(self, fs, root: str, files: list[tuple]):
        self.fs, self.root, self.files = fs, root, files
        self.firsts = [(key, page) for key, page, _, _ in files]
        self.now, self.block_now = None, None

    def _directory(self, k: int):
        if self.now != k:
            _, _, name, size = self.files[k]
            self.f = self.fs.open_input_file(f"{self.root}/{name}")
            self.f.seek(size - 16)
            end = self.f.read(16)
            if end[8:] != _MAGIC:
                raise ValueError("not an index file")
            length = struct.unpack("<Q", end[:8])[0]
            self.f.seek(size - 16 - length)
            self.blocks = json.loads(zlib.decompress(self.f.read(length)))
            self.heads = [(b[0], _number(b[1])) for b in self.blocks]
            self.now, self.block_now = k, None

    def _block(self, j: int):
        if self.block_now != j:
            self.f.seek(self.blocks[j][2])
            self.lines = json.loads(zlib.decompress(self.f.read(self.blocks[j][3])))
            self.names = [(x[0], _number(x[1])) for x in self.lines]
            self.block_now = j

    def find(self, key: str, page: int | None) -> list[list]:
        """All lines for a key and id; they may cross blocks and files."""
        want = key, _number(page)
        out: list[list] = []
        k = max(0, bisect_left(self.firsts, want) - 1)
        while k < len(self.files) and self.firsts[k] <= want:
            self._directory(k)
            j = max(0, bisect_left(self.heads, want) - 1)
            while j < len(self.blocks) and self.heads[j] <= want:
                self._block(j)
                out += self.lines[bisect_left(self.names, want) : bisect_right(self.names, want)]
                j += 1
            k += 1
        return out


def lookup(requests: DataFrame, files: list[tuple], folder: str) -> DataFrame:
    """Records of each distinct requested (url, page_id), read back through the index.

    Requests are sorted by key, so that a task walks through neighbouring blocks.
    Returns page_id, payload_bytes, payload_digest (of the payload as read, or of
    the original's as named by a revisit), record_type, refers_to.
    """
    spark = requests.sparkSession

    @F.arrow_udf("string")
    def keys(urls: pa.Array) -> pa.Array:
        return pa.array([surt(u) for u in urls.to_pylist()], pa.string())

    order = ["key", F.col("page_id").asc_nulls_first()]
    asked = requests.select(F.col("page_id").cast("long").alias("page_id"), keys(F.col("url")).alias("key"))
    asked = asked.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    shared = spark.sparkContext.broadcast(files)

    def run(batches):
        from collections import OrderedDict
        from hashlib import sha256

        fs, root = file_system(folder)
        ix, archives, last = Index(fs, root, shared.value), OrderedDict(), None
        for batch in batches:
            rows = []
            for want in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                if want == last:
                    continue
                last = want
                for _, page, name, start, length in ix.find(*want):
                    f = archives.pop(name, None) or fs.open_input_file(f"{root}/{name}")
                    archives[name] = f
                    if len(archives) > 64:
                        archives.popitem(last=False)[1].close()
                    f.seek(start)
                    fields, payload = parse(zlib.decompress(f.read(length), 31))
                    digest = fields["WARC-Payload-Digest"].partition(":")[2]
                    if fields["WARC-Type"] == "response" and sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't match its digest")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((page, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(refers[len("<urn:page:") : -1]) if refers else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return asked.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Writes one record per page, indexes them, and reads each back through the index.

    A null html is an empty payload. Of equal payloads of at least
    ``least_bytes``, rows with the smallest page_id are responses and others
    revisits of it; a null page_id never is the smallest if another is there.
    Repeated rows each have a record and a row. An empty table gives an empty
    result; other columns aren't read.
    """
    captures, folder = write(pages, settings)
    return lookup(pages.select("page_id", "url"), index(captures, folder, settings), folder)
