"""Importance resampling towards a target distribution, by sorting bucket streams.

Each batch of documents becomes one packed stream of 16-bit feature buckets with
the offsets of its documents, and the sorted stream as runs (bucket, count). The
streams are written; counts are the sums of the runs, read without the streams.
The gains of all buckets, a table of bounded size, then go to each task, which
reads streams, gathers gains and sums them between offsets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, ship
from .words import plain_words


@dataclass(frozen=True)
class Settings:
    #: At most 65,536, as a stream holds 16 bits for each feature.
    buckets: int = 10_000
    percent: int = 25
    min_words: int = 20
    seed: int = 7
    #: Rows that a range partition of the ranking gets on average at most.
    part_rows: int = 5_000_000


def feature_buckets(text: str | None, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each word and each pair of neighbours."""
    words = plain_words(text)
    if not words:
        return 0, np.zeros(0, np.uint16)
    single = list(map(zlib.crc32, words))
    # the checksum of a pair goes on from that of its first word
    pairs = map(zlib.crc32, [b" " + w for w in words[1:]], single)
    flat = np.fromiter((*single, *pairs), np.uint32, 2 * len(words) - 1)
    return len(words), (flat % np.uint32(buckets)).astype("<u2")


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs of the sorted stream."""
    if not len(stream):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ordered = np.sort(stream, kind="stable")  # a radix sort at this width
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
    return ordered[starts].astype(np.int32), np.diff(np.append(starts, len(ordered)))


_STREAMS = "doc_ids array<bigint>, words array<bigint>, offsets array<bigint>, stream binary, bucket array<int>, length array<bigint>"


def _streams(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = [feature_buckets(t, buckets) for t in batch.column("text").to_pylist()]
        stream = np.concatenate([x for _, x in found])
        offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in found])])
        bucket, length = runs(stream)
        cols = [pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([[n for n, _ in found]], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                pa.array([stream.tobytes()], pa.binary()), pa.array([bucket], pa.list_(pa.int32())), pa.array([length], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_ids", "words", "offsets", "stream", "bucket", "length"])


def write_streams(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The written streams of a table with doc_id and text: a row for each Arrow batch."""
    if not 0 < settings.buckets <= 1 << 16:
        raise ValueError("a bucket has to fit 16 bits")
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(texts.mapInArrow(lambda b: _streams(b, settings.buckets), _STREAMS), "streams", "zstd")


def bucket_counts(streams: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Features in each bucket, from the runs alone; at most ``buckets`` rows come to the driver."""
    run = streams.select(F.explode(F.arrays_zip("bucket", "length")).alias("run"))
    out = np.zeros(settings.buckets, np.int64)
    for r in run.groupBy("run.bucket").agg(F.sum("run.length").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of the smoothed shares of target and source, in doubles."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """The part of the score that is drawn by id: floor(-1000 ln(-ln u)); a null id counts as an empty one."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(batches, gains: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, words, offsets, stream in zip(*(batch.column(k) for k in range(4)), strict=True):
            ids, words = ids.as_py(), words.as_py()
            offsets = np.array(offsets.as_py(), np.int64)
            gathered = gains[np.frombuffer(stream.as_py(), "<u2")]
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            weights = np.zeros(len(ids), np.int64)
            if len(full):  # between the offsets of two empty documents there is nothing to sum
                weights[full] = np.add.reduceat(gathered, offsets[full]) // sizes[full]
            score = weights + np.array([noise(i, seed) for i in ids], np.int64)
            cols = [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(sizes), pa.array(weights), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight", "score"])


def weigh(streams: DataFrame, gains: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document, from the streams."""
    rows = streams.select("doc_ids", "words", "offsets", "stream")
    return rows.mapInArrow(lambda b: _weighed(b, gains, settings.seed), "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and the rank of those drawn.

    ``target`` has a column text. Null and empty texts have no features and
    weigh 0; a document without enough words is never drawn; each of repeated rows counts and may be
    drawn; ties go to the smaller id, nulls first. An empty target weighs by
    the smoothed shares alone; an empty table gives an empty result; columns
    other than doc_id and text aren't read.
    """
    spark, s = docs.sparkSession, settings
    streams = write_streams(docs, s)
    wanted = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), s)
    gains = bucket_gains(bucket_counts(streams, s), bucket_counts(wanted, s))
    weighed = materialise(weigh(streams, gains, s), "weighed")
    total, able = weighed.agg(F.count("*"), F.count_if(F.col("n_words") >= s.min_words)).first()
    drawn = s.percent * able // 100
    order = [F.col("short"), F.desc("score"), F.asc_nulls_first("doc_id"), F.col("weight"), F.col("n_features")]
    rows = weighed.withColumn("short", F.col("n_words") < s.min_words).drop("n_words")
    rows = rows.repartitionByRange(max(partitions(spark), -(-total // s.part_rows)), *order).sortWithinPartitions(*order)
    # the number of a row has its partition in the upper bits and its place in the lower 33
    placed = materialise(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int")), "placed")
    before, ahead = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect():  # one row for each partition
        before.append((r.part, ahead - r.first))
        ahead += r.n
    offsets = spark.createDataFrame(before, "part int, ahead long")
    rank = F.col("at") + F.col("ahead") + 1
    out = placed.join(F.broadcast(offsets), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(~F.col("short") & (rank <= drawn), rank).alias("rank"))
