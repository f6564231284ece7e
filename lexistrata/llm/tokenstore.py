"""Token ids of a corpus in wavelet-matrix shards.

Documents are range-partitioned and sorted by doc_id, tokenised where they
land, and written as shards of a bounded number of ids. A first table has one
row per shard; the ids before each partition come from one total per partition.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import file_system, materialise, partitions, scratch, ship
from .wavelet import WaveletFile, encode_file

_TOKENIZERS: dict = {}


@dataclass(frozen=True)
class Settings:
    end_id: int = 0
    #: A shard is closed once it holds so many ids.
    shard_tokens: int = 4_000_000


class _Words(dict):
    """Ids by word, as bytes; a new word is encoded.

    A table that is half full becomes the older half, from which words that are
    met again come back; the half before it goes.
    """

    def __init__(self, library, most: int):
        super().__init__()
        self.half = max(1, most // 2)
        self.older: dict = {}
        self.tokenize = library.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(spare) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            found = [t.id for t in self.tokenize(mapped)]
            ids = pack(f"<{len(found)}I", *found)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class _WordColumns:
    """Ids by word for columns of distinct words: new ones are encoded together.

    A table that is over its bound keeps the half met last.
    """

    #: new words that the library gets in one call
    at_once = 10_000

    def __init__(self, library, letters: dict, most: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.most, self.letters = most, letters
        # the library's model over words with a letter between them whose byte, 0xff, is in no UTF-8
        self.joined = Tokenizer(library.model)
        self.joined.pre_tokenizer = CharDelimiterSplit(chr(letters[255]))
        self.words = self.ids = pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)
        self.calls = 0

    def _encode(self, words: pa.Array) -> pa.Array:
        counts, blobs = [], []
        for a in range(0, len(words), self.at_once):
            some = words.slice(a, self.at_once)
            text = b"\xff".join(some.to_pylist()).decode("latin-1").translate(self.letters)
            found = self.joined.encode(text, add_special_tokens=False)
            blobs.append(np.array(found.ids, "<u4"))
            counts.append(np.bincount(found.word_ids, minlength=len(some)))
        return _binary(4 * np.concatenate(counts), np.concatenate(blobs))

    def __call__(self, words: pa.Array) -> pa.Array:
        at = pc.index_in(words, value_set=self.words)
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.words), len(self.words) + len(new))
            fresh = words.take(pa.array(new))
            self.words, self.ids = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.ids, self._encode(fresh)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.calls += 1
        self.met[at] = self.calls
        out = self.ids.take(pa.array(at))
        if len(self.met) > self.most:
            keep = np.argsort(self.met, kind="stable")[-max(1, self.most // 2) :]
            self.words, self.ids, self.met = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.met[keep]
        return out


def _binary(sizes: np.ndarray, data) -> pa.Array:
    """Column of byte strings of these sizes that lie one behind the other in the data."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


#: Kinds of bytes: letters (and what is not ASCII), digits, white space, others.
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE


def cuts(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Where words begin in texts one behind the other that begin at ``starts``, as the pattern of ``Tokens`` cuts each."""
    x = np.frombuffer(raw, np.uint8)
    n = len(x)
    kind = _KINDS[x]
    begins = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    first = np.zeros(n + 1, bool)
    first[starts] = first[n] = True
    begins |= first
    runs = np.flatnonzero(begins)
    # white space before something leaves its last character, and a blank goes to what follows
    after = runs[1:-1]
    after = after[(kind[after - 1] == _SPACE) & ~first[after]]
    begins[after - 1] = True
    begins[after[x[after - 1] == 32]] = False
    # a lone apostrophe takes one of these endings; with a blank before it, it begins no word
    quotes = np.flatnonzero((x == 39) & begins[:n])
    inside = ~first[quotes + 1]
    one, two = x[np.minimum(quotes + 1, n - 1)], x[np.minimum(quotes + 2, n - 1)] * ~first[np.minimum(quotes + 2, n)]
    short = inside & np.isin(one, list(b"stmd"))
    long = inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
    begins[quotes[short | long] + 1] = False
    begins[quotes[short] + 2] = True
    begins[quotes[long] + 3] = True
    return np.flatnonzero(begins[:n])


class Tokens:
    """Ids by the tokenizers library, with a bounded table of words met before.

    Words are the byte-level pre-tokenizer's: where a text has no letters or
    digits beyond Latin-1, a pattern of the same meaning cuts it, else the
    library does. Texts that hold a special token go to the library whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = self.library.pre_tokenizer.pre_tokenize_str
        self.words = _Words(self.library, most)
        self.most = most
        self.other = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]").search
        self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+").findall

    @cached_property
    def columns(self) -> _WordColumns:
        return _WordColumns(self.library, self.words.letters, self.most)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = [text[a:b] for _, (a, b) in self.pieces(text)] if self.other(text) else self.find(text)
        return b"".join(map(self.words.__getitem__, words))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for each of some texts, with every distinct word of theirs looked up once."""
        out: list[bytes] = [b""] * len(texts)
        plain, parts = [], []
        for k, text in enumerate(texts):
            if self.other(text) or any(s in text for s in self.special):
                out[k] = self.encode(text)
            elif text:
                plain.append(k)
                parts.append(text.encode())
        if not plain:
            return out
        raw = b"".join(parts)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        begins = cuts(raw, starts)
        words = _binary(np.diff(begins, append=len(raw)), raw).dictionary_encode()
        # the ids of all words lie one behind the other in the column's buffer
        _, at, data = self.columns(words.dictionary).take(words.indices).buffers()
        at = np.frombuffer(at, "<i8")[np.searchsorted(begins, [*starts, len(raw)])].tolist()
        view = memoryview(data)
        for k, a, b in zip(plain, at, at[1:], strict=False):
            out[k] = view[a:b].tobytes()
        return out


def tokens(path: str) -> Tokens:
    """The tokenizer of this process for a file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path)
    return _TOKENIZERS[path]


def write_store(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> tuple[DataFrame, str]:
    """Writes shards in ascending doc_id order (nulls first, equal ids by text).

    Returns one row per shard (part, shard, file, size, n_docs, n_tokens) and the
    folder. Null texts are empty and hold the end id alone.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = scratch(spark, "tokens")
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ordered = ordered.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id())
    end = np.array([settings.end_id], "<u4").tobytes()

    def run(batches):
        import uuid

        fs, root = file_system(folder)
        encode = tokens(tokenizer).encode_all
        ids: list = []
        blobs: list[bytes] = []
        held = number = part = 0

        def close():
            nonlocal ids, blobs, held, number
            flat = np.frombuffer(b"".join(blobs), "<u4")
            bits = max(1, int(flat.max()).bit_length())
            sizes = np.array([len(b) // 4 for b in blobs], "<i8")
            known = np.array([i is not None for i in ids], "<i8")
            tail = np.concatenate([np.array([i or 0 for i in ids], "<i8"), known, sizes]).tobytes()
            data = encode_file(flat, bits, {"docs": len(ids)}, tail)
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.wave"  # a second attempt of a task writes its own
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": number, "file": name, "size": len(data), "n_docs": len(ids), "n_tokens": len(flat)}], schema=schema)
            ids, blobs, held, number = [], [], 0, number + 1
            return row

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc, blob in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids.append(doc)
                blobs.append(blob + end)
                held += len(blobs[-1]) // 4
                if held >= settings.shard_tokens:
                    yield close()
        if ids:
            yield close()

    shards = ordered.mapInArrow(run, "part int, shard int, file string, size long, n_docs long, n_tokens long")
    return materialise(shards, "shards"), folder


def read_store(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    spark = shards.sparkSession
    # one total for each range partition: as many rows as the write had tasks
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, ahead = [], 0
    for part, n in totals:
        before.append((part, ahead))
        ahead += n
    offsets = spark.createDataFrame(before, "part int, ahead long")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    placed = placed.select("file", "size", (F.col("ahead") + F.col("inside")).alias("start"))

    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{root}/{r['file']}") as f:
                    w = WaveletFile(f, r["size"])
                    flat = memoryview(w.all().astype("<u4")).cast("B")
                    docs, known, sizes = np.frombuffer(w.tail(), "<i8").reshape(3, -1)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=known == 0), pa.array(starts + r["start"]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = placed.repartition(max(1, min(shards.count(), 4 * partitions(spark))), "file")
    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """Writes the store and reads it back: one row per document, repeated rows included.

    An empty table gives no shards and an empty result; columns other than
    doc_id and text aren't read.
    """
    return read_store(*write_store(docs, tokenizer, settings))
