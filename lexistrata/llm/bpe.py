"""Byte-level BPE: speculate with the greedy longest match, verify adjacent pairs.

A word's tokens are right if every token is what merging makes of its own bytes
and every adjacent pair (a, b) is what merging makes of a + b. So each new word
of a batch gets a proposal of longest matches; the distinct pairs of the whole
batch are checked together against the pairs known to be right or wrong (pairs
not yet known are merged once, as a two-token word); words with a wrong pair
are merged exactly. Words met again come from a bounded table.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

_CODECS: dict = {}
_SHIFT = 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Token bytes by id, merge ranks by pair of ids, and special tokens by text."""

    tokens: list[bytes]
    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(byte[c] for c in s)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in special}
        tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in vocab.items():
            tokens[i] = t
        for t, i in special.items():
            tokens[i] = t.encode()
        merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        return cls(tokens, vocab, merges, special)


def merge(word: bytes, v: Vocabulary) -> list[int]:
    """Exact merging: the lowest rank first, the leftmost of equals."""
    return _merge_short(word, v) if len(word) <= 48 else _merge_long(word, v)


def _merge_short(word: bytes, v: Vocabulary) -> list[int]:
    """By scanning all pairs for each merge."""
    ids = [v.ids[word[i : i + 1]] for i in range(len(word))]
    found = [v.merges.get(p) for p in zip(ids, ids[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, f in enumerate(found):
            if f is not None and (best is None or f < best):
                best, at = f, i
        if best is None:
            return ids
        ids[at : at + 2] = [best[1]]
        del found[at]
        if at:
            found[at - 1] = v.merges.get((ids[at - 1], ids[at]))
        if at < len(found):
            found[at] = v.merges.get((ids[at], ids[at + 1]))


def _merge_long(word: bytes, v: Vocabulary) -> list[int]:
    """With a heap of pairs over a linked list, for words of any length."""
    ids = [v.ids[word[i : i + 1]] for i in range(len(word))]
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    heap: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(ids) and (found := v.merges.get((ids[i], ids[j]))):
            heapq.heappush(heap, (found[0], i, found[1], ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else len(ids)
        if j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder with tables of words and pairs that it has met."""

    #: entries after which the tables of words and of pairs start anew; that of single tokens has at most the vocabulary's
    most_words = 400_000
    most_pairs = 2_000_000
    #: characters whose words are looked up together
    at_once = 4_000_000

    def __init__(self, path: str):
        import re

        from tokenizers import pre_tokenizers

        self.v = v = Vocabulary.load(path)
        self.longest = max(map(len, v.ids))
        self.pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else None
        self.words: dict[bytes, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.exact = 0
        # these are the pre-tokenizer's words where all letters and digits are these
        self.plain = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search
        self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+").findall
        self.odd = re.compile("[\x1c-\x1f]").search  # white space to Python only

    def _split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not self.plain(text) and not self.odd(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.pieces(text)]

    def _propose(self, word: bytes) -> list[int]:
        ids, out, i, n = self.v.ids, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while word[i:j] not in ids:
                j -= 1
            out.append(ids[word[i:j]])
            i = j
        return out

    def _is_sound(self, token: int) -> bool:
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = merge(self.v.tokens[token], self.v) == [token]
        return known

    def _check(self, keys: np.ndarray) -> np.ndarray:
        """For each pair key whether merging keeps its two tokens as they are."""
        distinct, back = np.unique(keys, return_inverse=True)
        known = self.pairs
        for key in distinct.tolist():
            if key not in known:
                a, b = key >> _SHIFT, key & (1 << _SHIFT) - 1
                known[key] = self._is_sound(a) and self._is_sound(b) and merge(self.v.tokens[a] + self.v.tokens[b], self.v) == [a, b]
        return np.array([known[k] for k in distinct.tolist()], bool)[back]

    def _learn(self, new: list[str]) -> None:
        """Adds words to the table: (ids joined by commas and a comma at the end)."""
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        proposals = [self._propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposals)), sizes)
        good = np.ones(len(proposals), bool)
        inside = owner[1:] == owner[:-1]
        good[owner[1:][inside][~self._check((flat[:-1] << _SHIFT | flat[1:])[inside])]] = False
        for k in np.flatnonzero(sizes == 1).tolist():
            good[k] = self._is_sound(proposals[k][0])
        for word, bytes_, ids, fits in zip(new, raw, proposals, good.tolist(), strict=True):
            if not fits:
                self.exact += 1
                ids = merge(bytes_, self.v)
            self.words[word] = b"".join(b"%d," % t for t in ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its decimal ids, each followed by a comma."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= self.at_once):
                held += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) if self.split else [t] for t in texts]
        # odd places hold special tokens
        words = [[self._split(p) if k % 2 == 0 else p for k, p in enumerate(ps)] for ps in parts]
        plain = [w for ws in words for w in ws if not isinstance(w, str)]
        if len(self.words) > self.most_words:
            self.words.clear()
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        self._learn(list({w for ws in plain for w in ws} - self.words.keys()))
        get = self.words.__getitem__
        return [b"".join(b"".join(map(get, w)) if not isinstance(w, str) else b"%d," % self.v.special[w] for w in ws) for ws in words]

    def decode(self, ids) -> str:
        return b"".join(map(self.v.tokens.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The codec of this process for a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def round_trip(text: Column, path: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of each whole text; null counts as empty."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(texts: pa.Array) -> pa.Array:
        from hashlib import sha256

        from lexistrata.llm.bpe import codec

        c, counts, ids_sha, text_sha = codec(path), [], [], []
        for line in c.encode([t or "" for t in texts.to_pylist()]):
            ids = np.fromstring(line[:-1], np.int64, sep=",") if line else np.zeros(0, np.int64)
            counts.append(len(ids))
            ids_sha.append(sha256(line[:-1]).hexdigest())
            text_sha.append(sha256(c.decode(ids.tolist()).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of its ids and of their decoded text.

    Null and empty texts have no tokens; special tokens in a text become their
    ids. Repeated rows each get a row, null ids stay null, an empty table gives
    an empty result, other columns aren't read.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", round_trip(F.col("text"), path).alias("t")).select("doc_id", "t.*")
