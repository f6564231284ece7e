"""Near-duplicates by the exact Jaccard similarity of word shingles, over SimHash fingerprints.

Fingerprints of 64 bits can't tell a similarity of 0.8 (some 10 bits apart) from
chance without losing links, so this stage widens them, and adds two things to
the method of ``simhash``: a meeting place that loses nothing, and proof.

1. Texts of the same words are one class. A class is the set of the hashes of
   its shingles, and has a fingerprint of 256 bits: the majority of each bit
   over four mixed forms of the hashes.
2. Under one order of all shingles, two sets of the wanted similarity share one
   of the first ``n - ceil(similarity * n) + 1`` shingles of each (prefix
   filter), so classes meet in buckets, one for each such shingle. Shingles that
   are common in a sample come last in the order; any order is right.
3. Inside a bucket few members, then more, are held against all others, until
   all pairs that aren't connected already were looked at. Pairs are discarded
   by their sizes, by the largest difference of their distances to reference
   fingerprints (pivot tables), by their own distance, and by parity bitmaps,
   which differ in no more bits than the sets do in shingles; survivors are
   verified on the whole sets.
4. Links join into components by ``simhash.components``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ship
from .simhash import components, references

_ROWS_AT_ONCE = 20_000
_SHINGLES_AT_ONCE = 50_000


@dataclass(frozen=True)
class Settings:
    shingle_words: int = 5
    #: Least similarity, as a fraction.
    over: int = 4
    under: int = 5
    #: Texts in the sample of common shingles, how often a common one occurs in it, and how many are told apart.
    sample: int = 4000
    common: int = 4
    most_common: int = 100_000
    #: Longs of a fingerprint, and bits that similar ones differ in at most. A bit differs with a chance of at most
    #: 0.19 where the similarity is 0.8, so a pair is lost with a chance under 2e-11 (Chernoff).
    longs: int = 4
    radius: int = 96
    #: Longs of a parity bitmap.
    bitmap: int = 8
    #: Reference fingerprints: those of the classes with the smallest hashes.
    references: int = 32
    #: Members of a bucket that are held against all others at first, and how many times more each round.
    hubs: int = 4
    growth: int = 8
    #: Members of a larger bucket are dealt out in blocks of so many, with its hubs in each.
    block: int = 512


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(text: str | None) -> int:
    """Signed hash of the words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = _words(text)
    return xxh64_intdigest(b" ".join(words), 7) - (1 << 63) if words else 0


def shingles(text: str | None, words_each: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, none without words."""
    from xxhash import xxh64_intdigest

    words = _words(text)
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - words_each + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    return np.unique(hashes.view(np.int64))


def similar(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * settings.under >= settings.over * (len(x) + len(y) - both)


def prefix(found: np.ndarray, common: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """The first shingles of a set; ``common`` (sorted) come last in the order."""
    n = len(found)
    size = n - -(-settings.over * n // settings.under) + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        late = common[at] == found
        found = np.concatenate([found[~late], found[late]])
    return found[:size]


def fingerprint(found: np.ndarray, longs: int) -> bytes:
    """Majority of each bit over mixed forms of the shingles' hashes, a long for each form."""
    salts = np.array(references(longs), np.uint64)
    total = np.zeros(64 * longs, np.int64)
    for k in range(0, len(found), _SHINGLES_AT_ONCE):
        mixed = _mixed((found[k : k + _SHINGLES_AT_ONCE, None].view(np.uint64) ^ salts).view(np.int64))
        total += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * total > len(found)).tobytes()


def bitmap(found: np.ndarray, longs: int) -> bytes:
    """Parity of the number of shingles at each place."""
    place = found.view(np.uint64) % np.uint64(64 * longs)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=64 * longs) & 1).tobytes()


def classes(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([class_of(x) for x in texts.to_pylist()], pa.int64())

    return run(text)


def _once(batches, make):
    """(class, made of its text) of each class of a task, once."""
    seen: set = set()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            c = class_of(text)
            if c and c not in seen:
                seen.add(c)
                yield c, make(text)


def _common(docs: DataFrame, total: int, settings: Settings) -> np.ndarray:
    """Shingles that are common in a sample, sorted; at most ``most_common``."""
    each = settings.shingle_words

    def run(batches):
        for _, found in _once(batches, lambda t: shingles(t, each)):
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, total // settings.sample))) == 0)
    counts = some.mapInArrow(run, "key bigint").groupBy("key").count().filter(F.col("count") >= settings.common)
    top = counts.orderBy(F.col("count").desc(), "key").limit(settings.most_common).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().astype(np.int64))


def _sketches(docs: DataFrame, common: np.ndarray, settings: Settings) -> DataFrame:
    """(doc_id, id) of each row, and (n, fp, bits, rare, late) where a task meets a class first.

    ``rare`` and ``late`` are the shingles of the prefix that aren't common, and that are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set = set()
        for batch in batches:
            ids, made = [], []
            for text in batch.column(1):
                text = text.as_py()
                c = class_of(text)
                ids.append(c)
                if not c or c in seen:
                    made.append((None,) * 5)
                    continue
                seen.add(c)
                found = shingles(text, settings.shingle_words)
                first = prefix(found, shared.value, settings)
                at = np.searchsorted(shared.value, first).clip(max=max(0, len(shared.value) - 1))
                late = shared.value[at] == first if len(shared.value) else np.zeros(len(first), bool)
                made.append((len(found), fingerprint(found, settings.longs), bitmap(found, settings.bitmap), first[~late], first[late]))
            cols = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "id", "n", "fp", "bits", "rare", "late"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, id bigint, n bigint, fp binary, bits binary, rare array<bigint>, late array<bigint>")


def _whole(batches, key: str, solve):
    """Calls ``solve`` with tables that hold whole groups of sorted rows."""
    held, waiting = None, []

    def join():
        t = pa.Table.from_batches(waiting)
        return t if held is None else pa.concat_tables([held, t])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < _ROWS_AT_ONCE:
            continue
        held, waiting = join(), []
        keys = held.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield from solve(held.slice(0, cut))
            held = held.slice(cut)
    if waiting:
        held = join()
    if held is not None and held.num_rows:
        yield from solve(held)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys, and the run of each row."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    return starts, sizes, np.repeat(np.arange(len(starts)), sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    z = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(31))


def _buckets(sketches: DataFrame) -> DataFrame:
    """(bucket, size, id) of the buckets that more than one class is in; those of the same classes are one.

    A bucket is named by a hash of its classes; equal names of different ones
    would only bring more pairs together. Rare shingles are dealt by themselves.
    Common ones, whose classes can be a large part of all, are counted by partial
    sums; they are at most ``most_common``.
    """
    name, size = F.bit_xor(F.xxhash64("id")).alias("bucket"), F.count("*").alias("size")
    rare = sketches.select("id", F.explode("rare").alias("key")).repartition("key").dropDuplicates(["key", "id"])
    key = Window.partitionBy("key")
    rare = rare.select("id", F.bit_xor(F.xxhash64("id")).over(key).alias("bucket"), F.count("*").over(key).alias("size")).filter("size > 1")
    late = materialise(sketches.select("id", F.explode("late").alias("key")).distinct(), "late")
    named = late.groupBy("key").agg(name, size).filter("size > 1")
    late = late.join(F.broadcast(named), "key")
    return rare.select("bucket", "size", "id").unionByName(late.select("bucket", "size", "id")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(id, found): shingles of the wanted classes."""

    def texts(batches):
        for c, text in _once(batches, lambda t: t):
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([text])], ["id", "text"])

    def run(batches):
        for c, found in _once(batches, lambda t: shingles(t, settings.shingle_words)):
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([found.tobytes()], pa.binary())], ["id", "found"])

    # copies of a text go on once from each task; written, so that a task has one Python worker at a time
    some = docs.select("text").mapInArrow(texts, "id bigint, text string").join(wanted, "id", "left_semi")
    return materialise(some.select("text"), "texts").mapInArrow(run, "id bigint, found binary").dropDuplicates(["id"])


def _pairs(rows: DataFrame, low: int, high: int, refs: np.ndarray, settings: Settings) -> DataFrame:
    """(a, b): pairs of each bucket, the lower of their places from ``low`` to below ``high``, where they aren't connected and may be similar.

    The place of a class in a bucket is its hash as a share of the bucket's size,
    so hubs are found without sorting a bucket, and are the same ones in all the
    buckets that classes share. a is the hub: b, not a, decides where a pair goes
    with the set of the other.
    """
    over, under, radius = settings.over, settings.under, settings.radius

    def solve(t: pa.Table):
        cell, ids, n, label, mark, hub = (t.column(c).to_numpy() for c in ("cell", "id", "n", "label", "mark", "hub"))
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        table = np.stack([np.bitwise_count(fp ^ r).sum(1, dtype=np.int16) for r in refs], 1)
        starts, sizes, run = _runs(cell)
        hubs = np.add.reduceat(hub.astype(np.int64), starts)
        # hubs stand first in their cell; each is a member of one block as well
        members = np.flatnonzero(~hub)
        for i in range(int(hubs.max(initial=0))):
            at = members[hubs[run[members]] > i]
            to = starts[run[at]] + i
            live = (mark[at] > mark[to]) & (label[at] != label[to]) & (over * np.maximum(n[at], n[to]) <= under * np.minimum(n[at], n[to]))
            at, to = at[live], to[live]
            near = (np.abs(table[at] - table[to]).max(1) <= radius) if len(at) else np.zeros(0, bool)
            at, to = at[near], to[near]
            true = np.bitwise_count(fp[at] ^ fp[to]).sum(1, dtype=np.int64) <= radius
            at, to = at[true], to[true]
            apart = np.bitwise_count(bits[at] ^ bits[to]).sum(1, dtype=np.int64)
            some = apart * (over + under) <= (under - over) * (n[at] + n[to])
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[to[some]]), pa.array(ids[at[some]])], ["a", "b"])

    blocks = F.ceil(F.col("size") / settings.block)
    mark = F.shiftrightunsigned(F.xxhash64("id"), 1)
    place = F.floor(mark.cast("double") / F.lit(float(1 << 63)) * F.col("size")).cast("bigint")
    rows = rows.withColumns({"mark": mark, "place": place}).filter(F.col("place") >= low)
    members = rows.withColumns({"part": F.pmod(F.xxhash64("id"), blocks), "hub": F.lit(False)})
    hubs = rows.filter(F.col("place") < high).withColumns({"part": F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)), "hub": F.lit(True)})
    dealt = members.unionByName(hubs).withColumn("cell", F.xxhash64("bucket", "part")).select("cell", "hub", "id", "n", "fp", "bits", "label", "mark")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", F.col("hub").desc(), "mark")
    return dealt.mapInArrow(lambda b: _whole(b, "cell", solve), "a bigint, b bigint").distinct()


def labels(docs: DataFrame, sketches: DataFrame, settings: Settings = Settings()) -> DataFrame | None:
    """(node, label): component of each class that a link leads to; None without links."""
    met = materialise(_buckets(sketches), "buckets")
    most = met.agg(F.max("size")).first()[0]
    if most is None:
        return None
    known = sketches.filter("fp IS NOT NULL").select("id", "n", "fp", "bits")
    refs = known.select(F.xxhash64("id").alias("h"), "fp").distinct().orderBy("h").limit(settings.references)
    refs = np.frombuffer(b"".join(bytes(r.fp) for r in refs.collect()), np.uint64).reshape(-1, settings.longs)
    rows = materialise(met.join(known.dropDuplicates(["id"]), "id"), "rows")

    @F.arrow_udf("boolean")
    def verified(x: pa.Array, y: pa.Array) -> pa.Array:
        whole = lambda v: np.frombuffer(v.as_buffer(), np.int64)
        return pa.array([similar(whole(a), whole(b), settings) for a, b in zip(x, y, strict=True)], pa.bool_())

    edges = named = sets = None
    low, high = 0, settings.hubs
    while low < most:
        now = rows.withColumn("label", F.col("id"))
        if named is not None:
            now = rows.join(named.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
            # buckets whose members are all connected are done with
            live = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")
            now = materialise(now.join(materialise(live, "live"), "bucket", "left_semi"), "now")
            rows = now.drop("label")
        pairs = materialise(_pairs(now, low, high, refs, settings), "pairs")
        if not pairs.isEmpty():
            wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            if sets is None:
                sets = materialise(_sets(docs, materialise(wanted, "wanted"), settings), "sets")
            else:
                wanted = materialise(wanted.join(sets.select("id"), "id", "left_anti"), "wanted")
                if not wanted.isEmpty():
                    sets = sets.unionByName(materialise(_sets(docs, wanted, settings), "sets"))
            pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
            more = materialise(pairs.filter(verified("x", "y")).select("a", "b"), "links")
            if not more.isEmpty():
                edges = more if edges is None else edges.unionByName(more)
                named = materialise(components(edges), "labels")
        low, high = high, settings.growth * high
    return named


def keep_first(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each component: the smallest by doc_id, null ids last, then by class and text.

    Rows are told apart by id and class, so a repeated id keeps a row of each
    component that its texts are in. Null, empty and blank texts are one class;
    texts of fewer words than a shingle are similar only to texts of the same
    words. An empty table gives an empty result; extra columns stay, whatever
    their names.
    """
    ship(docs.sparkSession)
    total = docs.count()
    sketches = materialise(_sketches(docs, _common(docs, total, settings), settings), "sketches")
    named = labels(docs, sketches, settings)
    placed = sketches.select("doc_id", F.col("id").alias("class")).withColumn("part", F.col("class"))
    if named is not None:
        placed = placed.join(named.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("part", F.coalesce("label", "class"))
    each = placed.groupBy("doc_id", "class", "part").agg(F.count("*").alias("rows"))
    each = materialise(each.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")), "placed")
    # written first, so that rows of a large component can be split where they meet it
    best = materialise(each.groupBy("part").agg(F.min("place").alias("best")), "best")
    gone = each.join(best, "part").filter(~F.col("place").eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("gone"), F.col("class").alias("of"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), classes(F.col("text")).alias("class"))
    # what goes grows with the input, so it is never broadcast; ids are even, texts need no sort
    rows = rows.join(gone.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("gone")) & (F.col("class") == F.col("of")), "left_anti")
    if not each.filter("rows > 1").isEmpty():
        first = Window.partitionBy("class").orderBy("row.text")
        rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return rows.select("row.*")
