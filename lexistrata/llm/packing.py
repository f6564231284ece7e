"""Optimal length buckets and token-budget batches.

A global histogram of document lengths goes to the driver (one row per
distinct length: with T tokens at most sqrt(2 T) of them). Dynamic programming
over it chooses the bucket boundaries with the least padding; the inner
minimum is found on a convex hull of lines, so a bucket costs time linear in
the number of lengths. Documents of a bucket, in an order spread by hash, then
fill batches of ``budget // boundary`` documents. Their token ids are written in
that order, so that a batch is one run of rows of the written table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, ship
from .tokenstore import tokens


@dataclass(frozen=True)
class Settings:
    buckets: int = 8
    budget: int = 65_536
    end_id: int = 0
    #: Bytes of ids that a range partition gets on average at most.
    part_bytes: int = 64 << 20


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length buckets with the least total padding.

    ``histogram`` has (length, documents). Ties take the smaller boundaries.
    """
    rows = sorted((n, c) for n, c in histogram if c > 0)
    d = len(rows)
    if not d:
        return []
    lengths = [n for n, _ in rows]
    docs = [0]
    for _, c in rows:
        docs.append(docs[-1] + c)
    # padded tokens of lengths i..j-1 in one bucket: lengths[j-1] * (docs[j] - docs[i])
    best: list[int | None] = [0] + [None] * d
    choices = []
    for _ in range(min(buckets, d)):
        hull: list[tuple[int, int, int]] = []  # lines y = b - docs[i] * x as (docs[i], b, i)
        at = 0
        now: list[int | None] = [None] * (d + 1)
        came = [0] * (d + 1)
        for j in range(1, d + 1):
            if best[j - 1] is not None:
                line = docs[j - 1], best[j - 1], j - 1
                while len(hull) - at >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) - at >= 2 and hull[at + 1][1] - hull[at + 1][0] * x < hull[at][1] - hull[at][0] * x:
                at += 1
            if len(hull) > at:
                m, b, i = hull[at]
                now[j] = b - m * x + docs[j] * x
                came[j] = i
        choices.append(came)
        best = now
        best[0] = None
    # the last layer has the least padding, as each further bucket can only lower it
    out, j = [], d
    for came in reversed(choices):
        out.append(lengths[j - 1])
        j = came[j]
    return out[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (b[0] - a[0]) <= (b[1] - a[1]) * (c[0] - a[0])


def _width(tokenizer: str) -> str:
    return "<u2" if tokens(tokenizer).library.get_vocab_size() <= 1 << 16 else "<u4"


def encoded(text: Column, tokenizer: str, settings: Settings = Settings()) -> Column:
    """Struct (n_tokens, ids) of each whole text with the end token, by the tokenizers library; null counts as empty.

    ``ids`` are little-endian, of 16 bits where the vocabulary fits, else of 32.
    """

    @F.arrow_udf("struct<n_tokens:bigint,ids:binary>")
    def run(texts: pa.Array) -> pa.Array:
        encode, kind = tokens(tokenizer).encode_all, _width(tokenizer)
        end = np.array([settings.end_id], kind).tobytes()
        ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in encode([x or "" for x in texts.to_pylist()])]
        return pa.StructArray.from_arrays([pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["n_tokens", "ids"])

    return run(text)


def pack_ids(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """The written batches: a row per document with doc_id, n_tokens, bucket (from 0), bucket_limit, padding, batch, slot, ids.

    Batches are numbered from 0 within a bucket and hold at most ``budget``
    padded tokens, or one document that is longer. Files are ordered by bucket
    and place, so a filter by bucket reads its files alone.
    """
    spark = docs.sparkSession
    ship(spark)
    sized = docs.select("doc_id", encoded(F.col("text"), tokenizer, settings).alias("t")).select("doc_id", "t.*")
    sized = materialise(sized, "encoded")
    # a row for each distinct length
    histogram = [(r.n_tokens, r.c) for r in sized.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()]
    ends = boundaries(histogram, settings.buckets) or [1]
    table = F.array(*map(F.lit, ends))
    order = ["bucket", "spread", "doc_id"]
    rows = sized.withColumn("bucket", F.size(F.filter(table, lambda e: e < F.col("n_tokens")))).withColumn("spread", F.xxhash64("doc_id", "n_tokens"))
    total = sum(n * c for n, c in histogram) * int(_width(tokenizer)[2:])
    rows = rows.repartitionByRange(max(partitions(spark), -(-total // settings.part_bytes)), *order).sortWithinPartitions(*order)
    # the number of a row has its partition in the upper bits and its place in the lower 33
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int"))
    placed = materialise(rows.drop("spread"), "placed", "zstd")
    # one row for each range partition and bucket in it: at most partitions + buckets
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    ahead, before = {}, []
    for r in sorted(counts, key=lambda r: (r.bucket, r.part)):
        before.append((r.bucket, r.part, ahead.get(r.bucket, 0) - r.first))
        ahead[r.bucket] = ahead.get(r.bucket, 0) + r.n
    offsets = spark.createDataFrame(before, "bucket int, part int, ahead long")
    limit = F.element_at(table, F.col("bucket") + 1).cast("long")
    room = F.greatest(F.lit(1), F.floor(F.lit(settings.budget) / F.col("bucket_limit"))).cast("long")
    out = placed.join(F.broadcast(offsets), ["bucket", "part"]).withColumn("bucket_limit", limit).withColumn("place", F.col("at") + F.col("ahead")).withColumn("room", room)
    out = out.withColumn("batch", F.floor(F.col("place") / F.col("room"))).withColumn("slot", F.col("place") % F.col("room"))
    return out.select("doc_id", "n_tokens", "bucket", "bucket_limit", (F.col("bucket_limit") - F.col("n_tokens")).alias("padding"), "batch", "slot", "ids")


def padded(batch: list, tokenizer: str, pad: int = 0) -> np.ndarray:
    """The ids of the rows of one batch as a matrix, in order of their slots, padded to the bucket's limit."""
    kind = _width(tokenizer)
    out = np.full((len(batch), batch[0].bucket_limit if batch else 0), pad, kind)
    for k, r in enumerate(sorted(batch, key=lambda r: r.slot)):
        out[k, : r.n_tokens] = np.frombuffer(bytes(r.ids), kind)
    return out


def pack(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """Writes the batches and reads them back: the rows of ``pack_ids`` with the CRC-32 of the ids in place of these.

    Null and empty texts have the end token alone. Repeated rows each get a place;
    a null doc_id has one too; an empty table gives an empty result; other columns
    aren't read.
    """
    out = pack_ids(docs, tokenizer, settings)
    return out.select(*(c for c in out.columns if c != "ids"), F.crc32("ids").alias("ids_crc32"))
