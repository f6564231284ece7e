"""Phrase collocation mining over compressed position bitmaps.

Each task writes shards: the words of one language in order, a gap wherever a
piece ends. In a shard a word is the bitmap of its positions. Shifting the
bitmap of a phrase by one and intersecting it with that of a word gives the
phrase made longer; as no word stands in a gap, no phrase crosses one. The
popcount is the shard's count, and the sum over shards the count of the corpus.

Three passes keep shards from extending what can't be frequent: words, then
pairs of frequent words, then the phrases whose adjacent pairs are all frequent.
Frequent words get numbers over the whole corpus, so a pair is one long. A shard
sends its counts as packed runs, one for each bucket of words or pairs; where a
bucket's runs meet they are summed, and each shard gets back which of its own
are frequent. So no task holds more than its shards or a bucket, whose number
grows with the corpus, and nothing is sent to all of them. A word or pair is in
a bucket once for each shard that has it. The frequent set itself is only ever a
distributed table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, ship

_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
_SHIFT = 32


@dataclass(frozen=True)
class Settings:
    least: int = 100
    longest: int = 5
    first: int = 2000
    #: A candidate goes if a longer one around it has this percentage of its occurrences.
    percent: int = 100
    #: Positions after which a shard is closed.
    shard: int = 1 << 21
    #: Entries of runs, and positions of shards, for which there is a bucket of words and of pairs.
    bucket: int = 1 << 20


# --- bitmaps -----------------------------------------------------------------


@dataclass(slots=True)
class Bits:
    """Positions as a bitmap: packed words where it is dense, else the places of its bits in order."""

    packed: np.ndarray | None
    at: np.ndarray | None

    @classmethod
    def of(cls, at: np.ndarray, span: int) -> Bits:
        """From sorted positions below ``span``; a place costs 32 bits, so that is the density from which packing is smaller."""
        if len(at) * 32 <= span:
            return cls(None, at.astype(np.uint32))
        flags = np.zeros(-(-span // 64) * 64, np.uint8)
        flags[at] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64), None)

    def count(self) -> int:
        return len(self.at) if self.packed is None else int(np.bitwise_count(self.packed).sum())

    def places(self) -> np.ndarray:
        return self.at if self.packed is None else np.flatnonzero(np.unpackbits(self.packed.view(np.uint8), bitorder="little"))

    def shifted(self) -> Bits:
        """One position further on; the last position of a shard is a gap, so no bit is lost."""
        if self.packed is None:
            return Bits(None, self.at + np.uint32(1))
        out = self.packed << np.uint64(1)
        out[1:] |= self.packed[:-1] >> np.uint64(63)
        return Bits(out, None)

    def meet(self, other: Bits) -> Bits:
        if self.packed is not None and other.packed is not None:
            return Bits(self.packed & other.packed, None)
        if self.packed is None and other.packed is None:
            return Bits(None, np.intersect1d(self.at, other.at, assume_unique=True))
        at, packed = (self.at, other.packed) if self.packed is None else (other.at, self.packed)
        return Bits(None, at[(packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)])


class Shard:
    """Position bitmaps of the words of a shard, and phrases by extending them."""

    def __init__(self, word_at: np.ndarray):
        """``word_at`` has the number of the word at each position, 0 for a gap or a word that doesn't count."""
        # codes in order of the numbers; one more gap makes 0 the first and lets every position have a next one
        self.words, self.at = np.unique(np.append(word_at, 0), return_inverse=True)
        self.span = len(self.at)
        dense = np.bincount(self.at, minlength=len(self.words)) * 32 > self.span
        dense[0] = False
        self.is_packed = dense
        self.packed = {c: Bits.of(np.flatnonzero(self.at == c), self.span) for c in np.flatnonzero(dense).tolist()}

    def phrases(self, pairs: np.ndarray | None, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(codes, counts) of the phrases of 2, 3, ... up to ``longest`` words, a row of codes for each; adjacent words are among ``pairs``.

        Packed bitmaps are extended depth-first: shifted, intersected with that of
        each packed word, counted by population. All that is kept as places is
        extended together, a length at a time: shifted places are grouped by the
        phrase that ends before and the word that stands there, which is the
        intersection with all words at once.
        """
        here, there = self.at[:-1], self.at[1:]
        goes_on = np.append((here > 0) & (there > 0), False)
        if pairs is not None:
            some = np.flatnonzero(goes_on)
            goes_on[some] = np.isin(self.words[here[some]] << _SHIFT | self.words[there[some]], pairs)
        self._allowed = None if pairs is None else set(pairs.tolist())
        self._goes_on = goes_on
        self._counted: list[list[tuple[tuple, int]]] = [[] for _ in range(longest + 1)]
        self._placed: list[list[tuple[tuple, np.ndarray]]] = [[] for _ in range(longest + 1)]
        for c, bits in self.packed.items():
            self._extend((c,), bits, longest)
        ends = np.flatnonzero(goes_on & ~self.is_packed[self.at])
        known, owner = np.arange(len(self.words))[:, None], self.at[ends]
        for k in range(1, longest):
            more = self._placed[k]
            if more:
                owner = np.concatenate([owner, np.repeat(np.arange(len(more)) + len(known), [len(e) for _, e in more])])
                known = np.concatenate([known, np.array([p for p, _ in more])])
                ends = np.concatenate([ends, *(e for _, e in more)])
            keys, owner, counts = np.unique(owner * len(self.words) + self.at[ends + 1], return_inverse=True, return_counts=True)
            known = np.column_stack([known[keys // len(self.words)], keys % len(self.words)])
            packed = self._counted[k + 1]
            if packed:
                yield np.array([p for p, _ in packed]), np.array([n for _, n in packed])
            if len(known):
                yield known, counts
            ends = ends + 1
            kept = goes_on[ends]
            ends, owner = ends[kept], owner[kept]

    def _extend(self, phrase: tuple, bits: Bits, longest: int) -> None:
        """Counts what packed words make of a packed phrase, and leaves the places of the rest to be extended together."""
        ends = bits.places()
        ends = ends[self._goes_on[ends]]
        self._placed[len(phrase)].append((phrase, ends[~self.is_packed[self.at[ends + 1]]]))
        after = bits.shifted()
        last = int(self.words[phrase[-1]]) << _SHIFT
        for c, word in self.packed.items():
            if self._allowed is not None and last | int(self.words[c]) not in self._allowed:
                continue
            found = after.meet(word)
            n = found.count()
            if not n:
                continue
            longer = (*phrase, c)
            self._counted[len(longer)].append((longer, n))
            if len(longer) == longest:
                continue
            if n * 32 > self.span:
                self._extend(longer, found, longest)
            else:
                at = found.places()
                self._placed[len(longer)].append((longer, at[self._goes_on[at]]))


# --- shards ------------------------------------------------------------------


class _Codes(dict):
    """Codes in order of appearance; the gap has 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _packed(x) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).data)


def _unpacked(x: bytes, kind: str = "<i8") -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _texts(x: bytes) -> list[bytes]:
    return _unpacked(x, "u1").tobytes().split(_BREAK)


def _shards(batches, positions: int) -> Iterator[pa.RecordBatch]:
    """Closes the largest language's shard whenever so many positions are held over all languages. Shards are numbered within the task that writes them."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << _SHIFT
    held: dict[str, list] = {}  # lang -> [codes of words, arrays, positions]
    total = 0

    def close(lang: str) -> pa.RecordBatch:
        nonlocal number
        number += 1
        words, arrays, _ = held.pop(lang)
        flat = np.concatenate(arrays)
        n = np.bincount(flat, minlength=len(words)).astype("<i8")
        row = {"shard": [number], "lang": [lang], "span": [len(flat)], "types": [len(words) - 1], "words": [_packed(_BREAK.join([b"", *list(words)[1:]]))], "n": [_packed(n)], "codes": [_packed(flat.astype("<u4"))]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("span", pa.int64()), ("types", pa.int64()), ("words", pa.binary()), ("n", pa.binary()), ("codes", pa.binary())]))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = text.encode().translate(_TABLE).replace(_BREAK, b" \xff ").split()
            if not found:
                continue
            words, arrays, _ = held.setdefault(lang, [_Codes(), [], 0])
            codes = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
            arrays.append(np.append(codes, np.uint32(0)))
            held[lang][2] += len(found) + 1
            total += len(found) + 1
            while total >= positions:
                largest = max(held, key=lambda x: held[x][2])
                total -= held[largest][2]
                yield close(largest)
    for lang in list(held):
        yield close(lang)


def _cut(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in order) of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for k, at in enumerate(np.split(order, ends[:-1])):
        if len(at):
            yield k, at


def _word_runs(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, shard, codes, words, n): the words of a shard by bucket."""
    for batch in batches:
        for r in batch.to_pylist():
            words, n = _texts(r["words"])[1:], _unpacked(r["n"])[1:]
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            rows = [{"lang": r["lang"], "bucket": k, "shard": r["shard"], "codes": _packed(at + 1), "words": _packed(_BREAK.join([words[i] for i in at.tolist()])), "n": _packed(n[at])} for k, at in _cut(bucket, buckets)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("shard", pa.int64()), ("codes", pa.binary()), ("words", pa.binary()), ("n", pa.binary())]))


_WORDS = "lang string, bucket int, shard long, codes array<int>, places array<int>, words array<string>, f array<long>, n long"


def _frequent_words(runs: pa.Table, least: int) -> pa.Table:
    """A row with the bucket's frequent words, their counts and the sum of all, and one for each shard with its codes of them and their places in that list."""
    rows = runs.to_pylist()
    totals: Counter = Counter()
    texts = [_texts(r["words"]) for r in rows]
    counts = [_unpacked(r["n"]).tolist() for r in rows]
    for words, n in zip(texts, counts, strict=True):
        for w, c in zip(words, n, strict=True):
            totals[w] += c
    place = {w: k for k, w in enumerate(sorted(w for w, f in totals.items() if f >= least))}
    head = {"lang": rows[0]["lang"], "bucket": rows[0]["bucket"]}
    out = [head | {"words": [w.decode() for w in place], "f": [totals[w] for w in place], "n": sum(totals.values())}]
    for r, words in zip(rows, texts, strict=True):
        codes = _unpacked(r["codes"])
        held = [k for k, w in enumerate(words) if w in place]
        if held:
            out.append(head | {"shard": r["shard"], "codes": codes[held].tolist(), "places": [place[words[k]] for k in held]})
    kinds = [("lang", pa.string()), ("bucket", pa.int32()), ("shard", pa.int64()), ("codes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("f", pa.list_(pa.int64())), ("n", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


def _numbers(r: dict) -> np.ndarray:
    """The number of the word at each position of a shard, 0 for a gap or a word that isn't frequent."""
    codes = _unpacked(r["codes"], "<u4")
    table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    for own in r["own"]:
        table[own["codes"]] = np.array(own["places"], np.int64) + own["ahead"]
    return table[codes]


def _pair_runs(batches, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, shard, pairs, n): the pairs of frequent words of a shard by bucket, as both numbers in one; sorted pairs are kept as steps."""
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(_numbers(r))
            found = [(shard.words[codes[:, 0]] << _SHIFT | shard.words[codes[:, 1]], n) for codes, n in shard.phrases(None, 2)]
            if not found:
                continue
            pairs, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(pairs)
            pairs, n = pairs[order], n[order]
            bucket = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            rows = [{"bucket": k, "shard": r["shard"], "pairs": _packed(np.diff(pairs[at], prepend=0)), "n": _packed(n[at].astype("<u4"))} for k, at in _cut(bucket, buckets)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("pairs", pa.binary()), ("n", pa.binary())]))


def _frequent_pairs(runs: pa.Table, least: int) -> pa.Table:
    """A row with the bucket's frequent pairs and their counts, and one for each shard with those of its own."""
    rows = runs.to_pylist()
    pairs = [np.cumsum(_unpacked(r["pairs"])) for r in rows]
    distinct, back = np.unique(np.concatenate(pairs), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, back, np.concatenate([_unpacked(r["n"], "<u4") for r in rows]).astype(np.int64))
    often = totals >= least
    out = [{"pairs": distinct[often].tolist(), "f": totals[often].tolist()}]
    for r, own, kept in zip(rows, pairs, np.split(often[back], np.cumsum([len(p) for p in pairs])[:-1]), strict=True):
        if kept.any():
            out.append({"shard": r["shard"], "pairs": own[kept].tolist()})
    return pa.Table.from_pylist(out, schema=pa.schema([("shard", pa.int64()), ("pairs", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))]))


def _longer_runs(batches, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, phrases, n): the phrases of three words or more over the frequent pairs of a shard, by bucket."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("phrases", pa.binary()), ("n", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(_numbers(r))
            words = _texts(r["words"])
            local = {p + own["ahead"]: c for own in r["own"] for c, p in zip(own["codes"], own["places"], strict=True)}
            texts = [words[local[x]] if x else b"" for x in shard.words.tolist()]
            pairs = np.sort(np.concatenate([np.array(p, np.int64) for p in r["pairs"]]))
            phrases: list[bytes] = []
            counts = []
            for codes, n in shard.phrases(pairs, longest):
                if codes.shape[1] > 2:
                    phrases += [b" ".join([texts[c] for c in p]) for p in codes.tolist()]
                    counts.append(n)
            if not phrases:
                continue
            flat = np.concatenate(counts).astype("<u4")
            bucket = np.fromiter(map(zlib.crc32, phrases), np.int64, len(phrases)) % buckets
            rows = [{"lang": r["lang"], "bucket": k, "phrases": _packed(_BREAK.join([phrases[i] for i in at.tolist()])), "n": _packed(flat[at])} for k, at in _cut(bucket, buckets)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _frequent_longer(runs: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, f): the bucket's frequent phrases."""
    totals: Counter = Counter()
    rows = runs.to_pylist()
    for r in rows:
        for p, n in zip(_texts(r["phrases"]), _unpacked(r["n"], "<u4").tolist(), strict=True):
            totals[p] += n
    often = [(p, f) for p, f in totals.items() if f >= least]
    cols = [pa.array([rows[0]["lang"]] * len(often), pa.string()), pa.array([p.decode() for p, _ in often], pa.string()), pa.array([f for _, f in often], pa.int64())]
    return pa.Table.from_arrays(cols, ["lang", "phrase", "f"])


def frequent_phrases(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``longest`` words with f of ``least`` or more, and (lang, n) with all words.

    Reads the columns text and lang.
    """
    spark = docs.sparkSession
    ship(spark)
    s = settings
    texts = docs.filter("text is not null").select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    shards = texts.mapInArrow(lambda b: _shards(b, s.shard), "shard long, lang string, span long, types long, words binary, n binary, codes binary")
    shards = materialise(shards, "shards")
    span, types = shards.agg(F.coalesce(F.sum("span"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    many = max(partitions(spark), -(-types // s.bucket))
    runs = shards.select("shard", "lang", "words", "n").mapInArrow(lambda b: _word_runs(b, many), "lang string, bucket int, shard long, codes binary, words binary, n binary")
    found = materialise(runs.groupBy("lang", "bucket").applyInArrow(lambda t: _frequent_words(t, s.least), _WORDS), "words", "zstd")
    totals = found.filter("shard IS NULL")
    # one row for each bucket and language
    sizes = [(r.lang, r.bucket, r.k) for r in totals.select("lang", "bucket", F.size("words").alias("k")).orderBy("lang", "bucket").collect()]
    before, ahead = [], 1
    for lang, bucket, k in sizes:
        before.append((lang, bucket, ahead))
        ahead += k
    if ahead >= 1 << 31:
        raise ValueError("two numbers of words have to fit a long")
    offsets = F.broadcast(spark.createDataFrame(before, "lang string, bucket int, ahead long"))
    words = totals.join(offsets, ["lang", "bucket"]).select("lang", "ahead", F.posexplode(F.arrays_zip("words", "f")).alias("place", "w"))
    words = words.select("lang", F.col("w.words").alias("phrase"), F.col("w.f").alias("f"), (F.col("ahead") + F.col("place")).alias("number"))
    # at most as many as a shard has words
    own = found.filter("shard IS NOT NULL").join(offsets, ["lang", "bucket"]).groupBy("shard").agg(F.collect_list(F.struct("codes", "places", "ahead")).alias("own"))

    many_pairs = max(partitions(spark), -(-span // s.bucket))
    runs = shards.select("shard", "codes").join(own, "shard").mapInArrow(lambda b: _pair_runs(b, many_pairs), "bucket int, shard long, pairs binary, n binary")
    found = materialise(runs.groupBy("bucket").applyInArrow(lambda t: _frequent_pairs(t, s.least), "shard long, pairs array<long>, f array<long>"), "pairs", "zstd")
    theirs = found.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("pairs").alias("pairs"))
    there = shards.select("shard", "lang", "words", "codes").join(own, "shard").join(theirs, "shard")
    runs = there.mapInArrow(lambda b: _longer_runs(b, s.longest, many_pairs), "lang string, bucket int, phrases binary, n binary")
    longer = runs.groupBy("lang", "bucket").applyInArrow(lambda t: _frequent_longer(t, s.least), "lang string, phrase string, f long")

    pairs = found.filter("shard IS NULL").select(F.explode(F.arrays_zip("pairs", "f")).alias("p")).select("p.pairs", "p.f")
    first, second = (words.select(F.col("number").alias(x), F.col("lang"), F.col("phrase").alias(f"{x}_word")) for x in ("first", "second"))
    named = pairs.select(F.shiftright("pairs", _SHIFT).alias("first"), F.col("pairs").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("second"), "f")
    named = named.join(first, "first").join(second.drop("lang"), "second").select("lang", F.concat_ws(" ", "first_word", "second_word").alias("phrase"), "f")
    every = words.select("lang", "phrase", "f").unionByName(named).unionByName(longer)
    return materialise(every, "frequent"), totals.groupBy("lang").agg(F.sum("n").alias("n"))


def exact_score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) of four long columns, in decimals of 38 digits."""
    wide = [f"cast({c} as decimal(38,0))" for c in ("1000", a, n, l, r)]
    return F.expr("({} * {} * {}) div ({} * {})".format(*wide))


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    Null texts count as empty and give nothing; null languages are ``und``; each
    of repeated rows counts; ties go by a, then by phrase in byte order; an empty
    table gives an empty result; columns other than text and lang aren't read.
    """
    s = settings
    counts, total = frequent_phrases(docs, s)
    parts = counts.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = parts.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", joined(F.lit(1), F.col("k"))).withColumn("right", joined(F.col("k") + 1, F.size("words") - F.col("k"))).drop("words")
    left, right = (counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])) for side in ("left", "right"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact_score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut"))
    # words inside a longer candidate: at most nine for each
    inside = parts.filter(F.size("words") > 2).select("lang", "f", "words", F.size("words").alias("size"))
    inside = inside.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left_over = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < s.percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    # the limit is applied before rows are shuffled, so a language's task gets so many from each other task at most
    ranked = left_over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
