"""Counts of typed phrases, exact, from shards of numbered tokens.

Each task writes shards: the tokens of its texts in order as codes, a gap where a
span ends. A token is known by its hash; the vocabulary shows whether two tokens
share one, and another salt is taken if so. Two exchanges follow. The first
counts adjacent pairs, cut to 40 bits, and tells each shard which of its own are
frequent: a rare one is in no frequent phrase, and two that share their bits only
let too many through. The second sends the places where phrases over frequent
pairs alone start to the bucket of their first two tokens, where phrases of each
length are told apart by their hashes whole and counted. Both send packed runs,
one for each bucket of a shard, and the number of buckets grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import shuffles_dropped, written
from ..functions.text import fold_token, is_cut

#: Words that join the parts of an expression.
CONNECTORS = ("a", "al", "and", "con", "da", "das", "de", "del", "do", "dos", "e", "el", "en", "for", "in", "la", "las", "los", "of", "para", "por", "que", "the", "to", "y")
#: Number words that never are content.
NUMBERS = ("uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "cien", "mil", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: Positions after which a shard is closed.
SHARD = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_JOINING, _NOT_CONTENT, _DIGITS = frozenset(CONNECTORS), frozenset(NUMBERS), frozenset("0123456789")


def kind(token: str) -> int:
    """2 content, 1 connector, 0 neither."""
    if token in _JOINING:
        return 1
    return 2 if len(token) >= 3 and token not in _NOT_CONTENT and _DIGITS.isdisjoint(token) else 0


# --- shards ------------------------------------------------------------------

_SHARD = "shard long, words array<string>, n array<long>, kinds binary, codes binary, ids binary, sizes binary, starts long"
_SCHEMA = pa.schema([("shard", pa.int64()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("kinds", "codes", "ids", "sizes")), ("starts", pa.int64())])


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).data) if len(x) else b""


def _unpacked(x: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x) if x else b"", dtype)


def _shard(number: int, tokens: list[pa.Array], sizes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Tokens are told apart once for the shard; each distinct one is folded once. Code 0 is the gap after each row and each cut."""
    coded = pa.concat_arrays(tokens).dictionary_encode()
    place: dict[str, int] = {}
    # a token of marks alone is none
    codes = [0 if is_cut(w) else place.setdefault(f, len(place) + 1) if (f := fold_token(w)) else -1 for w in coded.dictionary.to_pylist()]
    size, doc = np.concatenate(sizes), np.concatenate(ids)
    row = np.repeat(np.arange(len(size)), size + 1)
    at = np.zeros(len(row), np.int64)
    at[np.arange(len(coded)) + np.repeat(np.arange(len(size)), size)] = np.array(codes, np.int64)[coded.indices.to_numpy()] if len(coded) else 0
    row, at = row[at >= 0], at[at >= 0]
    kinds = np.array([0, *map(kind, place)], np.uint8)
    t = kinds[at]
    n = np.bincount(at, minlength=len(kinds))[1:]
    packed = [_packed(x) for x in (kinds, at.astype("<u4"), doc.astype("<i8"), np.bincount(row, minlength=len(size)).astype("<u4"))]
    cols = [[number], [list(place)], [n], *([x] for x in packed), [int(((t[:-1] == 2) & (t[1:] > 0)).sum())]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def _shards(batches, positions: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: tuple[list, list, list] = ([], [], [])
    total = 0
    for batch in batches:
        lists = batch.column("s")
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        ids = np.asarray(pc.fill_null(batch.column("id"), -(1 << 63)), np.int64)
        flat = lists.flatten()
        ends = np.cumsum(size)
        first = 0
        while first < len(size):
            # rows up to the one with which the shard is full
            before = int(ends[first] - size[first])
            last = min(len(size), int(np.searchsorted(ends, before + positions - total)) + 1)
            for x, part in zip(held, (flat.slice(before, int(ends[last - 1]) - before), size[first:last], ids[first:last]), strict=True):
                x.append(part)
            total += int(ends[last - 1]) - before
            first = last
            if total >= positions:
                number += 1
                yield _shard(number, *held)
                held, total = ([], [], []), 0
    if held[0]:
        yield _shard(number + 1, *held)


def shards(rows: DataFrame, positions: int = SHARD) -> DataFrame:
    """Shards of the columns id and s, written: tokens of ``s`` in order, cut at its end and wherever it holds a cut."""
    return written(rows.select(F.col("id").cast("long").alias("id"), "s").mapInArrow(lambda b: _shards(b, positions), _SHARD), codec="zstd")


def vocabulary(of: DataFrame) -> tuple[DataFrame, int]:
    """(token, h, fp) of all tokens of shards, written, and the salt of the hashes: the first with which each token has one of its own, and none has 0."""
    each = of.select(F.explode(F.arrays_zip("words", "n")).alias("w")).select(F.col("w.words").alias("token"), F.col("w.n").alias("n"))
    words = written(each.groupBy("token").agg(F.sum("n").alias("fp")))
    for salt in range(64):
        hashed = words.select("token", F.xxhash64(F.lit(salt), "token").alias("h"), "fp")
        if hashed.groupBy("h").count().filter("count > 1 OR h = 0").isEmpty():
            return hashed, salt
    raise ValueError("tokens share hashes with each salt")


# --- pairs -------------------------------------------------------------------


def _typed(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and kind at each position of a shard."""
    hashes = np.append(np.uint64(0), np.asarray(batch.column("h")[k].values).astype(np.int64).view(np.uint64))
    codes = _unpacked(batch.column("codes")[k].as_py(), "<u4")
    return hashes[codes], _unpacked(batch.column("kinds")[k].as_py(), "u1")[codes]


def _pairs(h: np.ndarray, t: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with a pair that a phrase may hold, and its bucket and 32 more bits in one number."""
    at = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
    x = h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return at, ((x >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | x & _LOW).astype(np.int64)


def _pair_runs(batches, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, shard, pairs, n): the distinct pairs of a shard by bucket, in order, as steps; counts up to ``least``."""
    schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("pairs", pa.binary()), ("n", pa.binary())])
    for batch in batches:
        for k in range(batch.num_rows):
            pairs, n = np.unique(_pairs(*_typed(batch, k), buckets)[1], return_counts=True)
            n = np.minimum(n, least).astype("<u4")
            found, first = np.unique(pairs >> 32, return_index=True)
            ends = np.append(first[1:], len(pairs))
            low = pairs & 0xFFFFFFFF
            cols = [found.astype(np.int32), np.full(len(found), batch.column("shard")[k].as_py()), [_packed(np.diff(low[a:b], prepend=0).astype("<u4")) for a, b in zip(first, ends, strict=True)], [_packed(n[a:b]) for a, b in zip(first, ends, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _frequent_pairs(runs: pa.Table, least: int) -> pa.Table:
    """(shard, bucket, often): a bit for each pair of a shard's run."""
    pairs = [np.cumsum(_unpacked(x, "<u4").astype(np.int64)) for x in runs.column("pairs").to_pylist()]
    distinct, back = np.unique(np.concatenate(pairs), return_inverse=True)
    totals = np.bincount(back, np.concatenate([_unpacked(x, "<u4") for x in runs.column("n").to_pylist()]), len(distinct))
    often = np.split((totals >= least)[back], np.cumsum([len(p) for p in pairs])[:-1])
    return pa.table({"shard": runs.column("shard"), "bucket": runs.column("bucket"), "often": pa.array([np.packbits(x).tobytes() for x in often], pa.binary())})


# --- places ------------------------------------------------------------------


def _places(h: np.ndarray, t: np.ndarray, goes_on: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where phrases start, and how far the longest reaches: over frequent pairs alone, from a content word to a content word."""
    here = np.arange(len(t))
    stop = np.minimum.accumulate(np.where(goes_on, len(t), here)[::-1])[::-1]  # the last token that may follow
    content = np.maximum.accumulate(np.where(t == 2, here, -1))
    at = np.flatnonzero((t == 2) & goes_on)
    reach = content[np.minimum(stop[at], at + longest - 1)] - at + 1
    return at[reach > 1], reach[reach > 1]


def _place_runs(batches, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n, ids, reach, ends, left, tokens): the places of a shard by bucket; ``tokens`` column by column, up to the one after the longest phrase."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in ("ids", "reach", "ends", "left", "tokens"))])
    for batch in batches:
        for k in range(batch.num_rows):
            h, t = _typed(batch, k)
            ids = np.repeat(_unpacked(batch.column("ids")[k].as_py(), "<i8"), _unpacked(batch.column("sizes")[k].as_py(), "<u4"))
            own, keys = _pairs(h, t, buckets)
            distinct, back = np.unique(keys, return_inverse=True)
            often = np.zeros(len(distinct), bool)
            bucket = distinct >> 32
            for r in batch.column("pairs")[k].as_py():
                a, b = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
                often[a:b] = np.unpackbits(np.frombuffer(r["often"], np.uint8), count=b - a)
            goes_on = np.zeros(len(t), bool)
            goes_on[own] = often[back]
            at, reach = _places(h, t, goes_on, longest)
            key = keys[np.searchsorted(own, at)]
            order = np.argsort(key, kind="stable")
            at, reach, key = at[order], reach[order], key[order]
            h, t = np.append(h, np.zeros(longest + 1, np.uint64)), np.append(t, np.zeros(longest + 1, np.uint8))
            tokens = [np.where(reach >= j, h[at + j], 0) for j in range(longest + 1)]
            ends = sum(((t[at + j - 1] == 2) & (reach >= j)).astype(np.int32) << j for j in range(2, longest + 1))
            left = np.where(at > 0, h[at - 1], 0)
            found, first = np.unique(key >> 32, return_index=True)
            cuts = list(zip(first, np.append(first[1:], len(key)), strict=True))
            pack = lambda x, dtype: [_packed(x[a:b].astype(dtype)) for a, b in cuts]
            cols = [found, [b - a for a, b in cuts], pack(ids[at], "<i8"), pack(reach, "u1"), pack(ends, "<i4"), pack(left, "<u8"), [_packed(np.concatenate([x[a:b] for x in tokens])) for a, b in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _most(group: np.ndarray, beside: np.ndarray, groups: int) -> np.ndarray:
    """How often the commonest neighbour of each group stands there; 0 is none."""
    group, beside = group[beside > 0], beside[beside > 0]
    out = np.zeros(groups, np.int64)
    if len(group):
        keys, n = np.unique(group * (int(beside.max()) + 1) + beside, return_counts=True)
        np.maximum.at(out, keys // (int(beside.max()) + 1), n)
    return out


_COUNTED = "gram array<long>, head int, f long, docs long, most long"


def _counted(runs: pa.Table, least: int, longest: int, beside: bool) -> pa.Table:
    """The bucket's phrases found ``least`` times. Places are parted by one more token at a time; those whose phrase is rare go."""
    columns = {x: [_unpacked(b, d) for b in runs.column(x).to_pylist()] for x, d in (("ids", "<i8"), ("reach", "u1"), ("ends", "<i4"), ("left", "<u8"), ("tokens", "<u8"))}
    ids, reach, ends, left = (np.concatenate(columns[x]) for x in ("ids", "reach", "ends", "left"))
    tokens = np.concatenate([x.reshape(longest + 1, -1) for x in columns["tokens"]], axis=1)
    # numbers in place of hashes; 0 stays 0, being the least
    known, code = np.unique(np.concatenate([[np.uint64(0)], left, tokens.ravel()]), return_inverse=True)
    left, tokens = code[1 : len(left) + 1], code[len(left) + 1 :].reshape(longest + 1, -1)
    docs, ids = np.unique(ids, return_inverse=True)
    group, at = tokens[0], np.arange(len(ids))
    parts = []
    for n in range(2, longest + 1):
        on = reach[at] >= n
        at, group = at[on], group[on]
        if not len(at):
            break
        _, first, group, f = np.unique(group * len(known) + tokens[n - 1][at], return_index=True, return_inverse=True, return_counts=True)
        often = f >= least
        ended = often & (ends[at[first]] >> n & 1 == 1)
        if ended.any():
            place = np.cumsum(ended) - 1
            own = ended[group]
            g, where, groups = place[group[own]], at[own], int(ended.sum())
            spread = np.bincount(np.unique(g * len(docs) + ids[where]) // len(docs), minlength=groups)
            most = np.maximum(_most(g, left[where], groups), _most(g, tokens[n][where], groups)) if beside else np.zeros(groups, np.int64)
            grams = known[tokens[:n, at[first[ended]]].T].view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(groups + 1, dtype=np.int32) * n, np.ascontiguousarray(grams).ravel())
            before = (ends[at[first[ended]]] & (1 << n) - 1 | 2).astype(np.float64)  # the first token is content
            parts.append(pa.table({"gram": lists, "head": (np.frexp(before)[1] - 1).astype(np.int32), "f": f[ended].astype(np.int64), "docs": spread.astype(np.int64), "most": pa.array(most, pa.int64(), mask=most == 0)}))
        at, group = at[often[group]], group[often[group]]
    schema = pa.schema([("gram", pa.list_(pa.int64())), ("head", pa.int32()), *((x, pa.int64()) for x in ("f", "docs", "most"))])
    return pa.concat_tables([p.cast(schema) for p in parts]) if parts else schema.empty_table()


def _buckets(spark: SparkSession, entries: int, places: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // places))


def count(of: DataFrame, salt: int, least: int, longest: int = 7, beside: bool = False, places: int = 1 << 20) -> DataFrame:
    """(gram, head, f, docs, most), written: all phrases of two to ``longest`` tokens of shards that are met ``least`` times.

    They start and end with content words and hold these and connectors alone.
    ``gram`` has the hashes of ``vocabulary``, ``head`` is the length up to the last
    content word but one. ``most`` is null unless ``beside``: how often the commonest
    neighbour on one side stands there. For each ``places`` places there is a bucket.
    """
    spark = of.sparkSession
    buckets = _buckets(spark, of.agg(F.sum("starts")).first()[0] or 0, places)
    hashed = of.withColumn("h", F.transform("words", lambda w: F.xxhash64(F.lit(salt), w)))
    with shuffles_dropped(spark):
        runs = hashed.select("shard", "h", "kinds", "codes").mapInArrow(lambda b: _pair_runs(b, least, buckets), "bucket int, shard long, pairs binary, n binary")
        pairs = written(runs.groupBy("bucket").applyInArrow(lambda t: _frequent_pairs(t, least), "shard long, bucket int, often binary"))
        own = pairs.groupBy("shard").agg(F.collect_list(F.struct("bucket", "often")).alias("pairs"))
        there = hashed.select("shard", "h", "kinds", "codes", "ids", "sizes").join(own, "shard")
        runs = there.mapInArrow(lambda b: _place_runs(b, longest, buckets), "bucket int, n int, ids binary, reach binary, ends binary, left binary, tokens binary")
        return written(runs.groupBy("bucket").applyInArrow(lambda t: _counted(t, least, longest, beside), _COUNTED))


def named(grams: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct rows with the tokens of ``gram`` in place of their hashes, joined by spaces."""
    each = grams.select("*", F.posexplode("gram").alias("pos", "h")).join(words.select("token", "h"), "h")
    at = each.groupBy(*grams.columns).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("at"))
    return at.select(*(F.array_join("at.token", " ").alias(c) if c == "gram" else c for c in grams.columns))
