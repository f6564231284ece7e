"""SimHash near-duplicates by pivot distance tables.

1. Each text gets a 64-bit fingerprint of its word shingles; equal fingerprints
   are one class from then on, so copies are never paired.
2. Each distinct fingerprint carries a table: its Hamming distances to fixed
   reference fingerprints. By the triangle inequality, two fingerprints within
   distance r differ by at most r in every entry.
3. Fingerprints meet where enough of their bit bands agree (any two within r do).
   Inside such a bucket they are swept in order of the first entry; pairs whose
   largest difference of entries exceeds r are discarded, survivors verified by
   their true distance. Pairs already connected are skipped, so a bucket gives
   at most one link fewer than it has members.
4. Links join into components by rounds of hooking and pointer jumping.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

_SHINGLES_AT_ONCE = 200_000
#: Rows of sorted buckets swept together.
_ROWS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Settings:
    shingle_words: int = 4
    radius: int = 4
    references: int = 16
    #: Buckets of more fingerprints are dealt out in pairs of blocks of so many.
    block: int = 2048
    #: Mean bucket size up to which more bands aren't needed.
    mean_bucket: int = 256


def references(n: int) -> list[int]:
    """``n`` fixed 64-bit reference fingerprints, from a seeded mixing rule."""
    out, x, full = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & full
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append(z ^ (z >> 31))
    return out


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - words_each + 1)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, n, _SHINGLES_AT_ONCE):
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[k : k + _SHINGLES_AT_ONCE], stops[k : k + _SHINGLES_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint(x, settings.shingle_words) for x in texts.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    ship(docs.sparkSession)
    return docs.select("doc_id", run(F.col("text")).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(fp: Column, refs: list[int]) -> list[Column]:
    """Distances to the references, eight to a long."""
    one = lambda r, k: F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("long"), 8 * k)
    return [reduce(lambda a, b: a.bitwiseOR(b), (one(r, k) for k, r in enumerate(refs[i : i + 8]))).alias(f"t{i // 8}") for i in range(0, len(refs), 8)]


def _bands(n: int, radius: int, mean_bucket: int) -> list[int]:
    """Masks such that fingerprints within the radius agree on at least one of them.

    With radius + k bands, k of them agree; k grows until a bucket of random
    fingerprints is small on average.
    """
    k = 1
    while k < 5 and n > mean_bucket << (64 * k // (radius + k)):
        k += 1
    count = radius + k
    edges = [round(64 * i / count) for i in range(count + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(count)]
    return [reduce(int.__or__, c) for c in combinations(masks, k)]


class _Forest:
    """Components of a run of rows, labels kept flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins pairs; returns those that connected something."""
        kept_a, kept_b = [], []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(int(self.label[i])), root(int(self.label[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept_a.append(i)
                kept_b.append(j)
        if parent:
            moved = np.array(list(parent))
            to = np.array([root(x) for x in parent])
            table = np.arange(len(self.label))
            table[moved] = to
            self.label = table[self.label]
        return np.array(kept_a, np.int64), np.array(kept_b, np.int64)


def _sweep(group: np.ndarray, block: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int):
    """Links (i, j) within groups; rows are sorted by group, then by the first distance."""
    n = len(fp)
    forest = _Forest(n)
    at = np.arange(n)
    step = 0
    out = []
    while len(at):
        step += 1
        at = at[at + step < n]
        to = at + step
        on = (group[at] == group[to]) & (table[to, 0].astype(np.int16) - table[at, 0] <= radius)
        at = at[on]
        to = at + step
        live = (forest.label[at] != forest.label[to]) & ((block[at] != block[to]) | (block[at] < 0))
        a, b = at[live], to[live]
        near = (np.abs(table[a].astype(np.int16) - table[b]).max(1) <= radius) if len(a) else np.zeros(0, bool)
        a, b = a[near], b[near]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if true.any():
            out.append(forest.join(a[true], b[true]))
    return out


def links(distinct: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """(a, b) links between ``n`` distinct fingerprints, spanning each component of every bucket."""
    spark = distinct.sparkSession
    refs = references(settings.references)
    masks = _bands(n, settings.radius, settings.mean_bucket)
    keys = F.array(*(F.struct(F.lit(i).cast("short").alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    rows = distinct.select("fp", *_table(F.col("fp"), refs), F.explode(keys).alias("k")).select("k.*", "fp", *(f"t{i}" for i in range(settings.references // 8)))
    large = rows.groupBy("band", "key").count().filter(F.col("count") > settings.block)
    large = materialise(large.select("band", "key", F.ceil(F.col("count") / settings.block).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(-1)})
    else:
        rows = rows.join(large, ["band", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "own": F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))}).drop("blocks", "other")
        # pairs inside a block have a group of their own (own is -1 there)
    group = ["band", "key", "lo", "hi"]
    width = settings.references

    def run(batches):
        held: pa.Table | None = None
        waiting: list = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < _ROWS_AT_ONCE:
                continue
            t, waiting = pa.Table.from_batches(waiting), []
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(c)[-1].as_py() for c in group]
            same = np.ones(held.num_rows, bool)
            for c, v in zip(group, last, strict=True):
                same &= held.column(c).to_numpy() == v
            cut = held.num_rows - int(same.sum())
            if cut:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if waiting:
            t = pa.Table.from_batches(waiting)
            held = t if held is None else pa.concat_tables([held, t])
        if held is not None and held.num_rows:
            yield from solve(held)

    def solve(t: pa.Table):
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        change = np.zeros(t.num_rows, bool)
        for c in group:
            change[1:] |= cols[c][1:] != cols[c][:-1]
        table = np.stack([cols[f"t{i}"] for i in range(width // 8)], 1).astype(np.int64).view(np.uint8).reshape(-1, width)
        fp = cols["fp"].astype(np.int64).view(np.uint64)
        number = np.cumsum(change)
        order = np.lexsort((fp, table[:, 0], number))
        for a, b in _sweep(number[order], cols["own"][order], fp[order], table[order], settings.radius):
            if len(a):
                x, y = fp[order][a].view(np.int64), fp[order][b].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that links lead to; only nodes with links.

    Each round hooks a component onto its smallest neighbour and jumps pointers;
    what connects nothing any more is dropped. Rounds grow with the logarithm of
    the longest path.
    """
    edges = materialise(edges.select("a", "b"), "edges")
    tops = None
    live = edges
    while not live.isEmpty():
        # every node that has a smaller neighbour points to the smallest one
        both = live.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
        hook = materialise(both.groupBy("node").agg(F.min("to").alias("to")), "hook")
        while True:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = hook.join(up, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            jumped = materialise(jumped, "jump")
            moved = not jumped.filter("moved").isEmpty()
            hook = jumped.select("node", "to")
            if not moved:
                break
        if tops is None:
            tops = hook
        else:
            next_up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            tops = tops.join(next_up, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
            tops = materialise(tops.unionByName(hook.join(tops.select("node"), "node", "left_anti")), "tops")
        a_up = hook.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        b_up = hook.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved_edges = live.join(a_up, "a", "left").join(b_up, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        live = materialise(moved_edges.filter("a <> b").distinct(), "live")
    if tops is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return tops.select("node", F.col("to").alias("label")).unionByName(tops.select(F.col("to").alias("node"), F.col("to").alias("label")).distinct())


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Null and empty texts have the zero fingerprint, linked like any other.
    Repeated rows each get a row, in the same component. A null doc_id gets the
    component of its fingerprint; component_id is null only if all ids of the
    component are. An empty table gives an empty result; other columns aren't read.
    """
    fps = materialise(fingerprints(docs, settings), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distinct.count(), settings))
    named = materialise(roots, "roots").withColumnRenamed("node", "fp")
    # classes in no link stand for themselves
    classes = distinct.join(named, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    classes = materialise(classes, "classes")
    # written first, so that the rows of a large component can be split where they meet it
    first = materialise(classes.groupBy("label").agg(F.min("first").alias("component_id")), "first")
    known = classes.select("fp", "label").join(first, "label").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
