"""Quality rules: word statistics and bands of zstandard compression ratios.

A document passes the bands if the ratio (compressed bytes / bytes) of its
whole text lies inside the limits for its length, and at most a given share of
its fixed-size chunks lies outside the limits for theirs. Low ratios mean
repetition, high ones noise.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: (bytes from, lowest ratio, highest ratio); the last row that a length reaches holds. Ratios fall with the length, so
#: each doubling has its own lowest one: 3 % below the least that a labelled good document of that length had. Under 16
#: bytes a text can't have ten words and fails the word rules at any ratio.
BANDS = (
    (0, 0.0, float("inf")),
    (16, 0.95, 1.60),
    (64, 0.77, 1.25),
    (128, 0.62, 1.00),
    (256, 0.56, 0.90),
    (512, 0.49, 0.80),
    (1024, 0.45, 0.75),
    (2048, 0.435, 0.72),
    (4096, 0.41, 0.70),
    (8192, 0.40, 0.70),
    (16384, 0.39, 0.68),
    (65536, 0.34, 0.68),
)
#: Windows of longer texts are counted in arrays, not as tuples.
_ARRAYS_FROM = 50_000

SCHEMA = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
    "n_repeat_words:bigint,base_failed:boolean,doc_ratio:double,bad_chunk_share:double,kept:boolean>"
)


@dataclass(frozen=True)
class Limits:
    bands: tuple = BANDS
    chunk_bytes: int = 4096
    bad_chunk_share: float = 0.34
    level: int = 3
    min_words: int = 10
    repeat_percent: int = 20


def _covered(starts: np.ndarray, size: int) -> int:
    """Positions covered by windows of ``size`` at the sorted ``starts``."""
    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts), size).sum()) + size


def repeat_words(words: list, size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) < _ARRAYS_FROM:
        windows = list(zip(*(words[k:] for k in range(size)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        return _covered(np.array([i for i, w in enumerate(windows) if seen[w] > 1]), size)
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    window = code[:n]
    for k in range(1, size):
        window = np.unique(window << 32 | code[k : k + n], return_inverse=True)[1]
    return _covered(np.flatnonzero(np.bincount(window)[window] > 1), size)


def _band(n: int, bands: tuple) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for start, a, b in bands:
        if n >= start:
            low, high = a, b
    return low, high


def _chunks(raw: bytes, size: int) -> list[bytes]:
    """Chunks of ``size`` bytes; a rest under a quarter joins the last one."""
    cuts = list(range(0, len(raw), size))
    if len(cuts) > 1 and len(raw) - cuts[-1] < size // 4:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def profile(text: str | None, limits: Limits, compress) -> tuple:
    """The row of ``SCHEMA`` for one text; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - sum(map(len, words)))  # white space is one byte each
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = repeat_words(words)
    failed = n < limits.min_words or 100 * repeated > limits.repeat_percent * n
    ratio, bad = None, 0.0
    if raw:
        ratio = len(compress(raw)) / len(raw)
        parts = _chunks(raw, limits.chunk_bytes)
        ratios = [ratio] if len(parts) == 1 else [len(compress(x)) / len(x) for x in parts]
        bands = [_band(len(x), limits.bands) for x in parts]
        bad = sum(not a <= r <= b for r, (a, b) in zip(ratios, bands, strict=True)) / len(parts)
    low, high = _band(len(raw), limits.bands)
    fits = ratio is None or (low <= ratio <= high and bad <= limits.bad_chunk_share)
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, ratio, bad, not failed and fits


def quality(text: Column, limits: Limits = Limits()) -> Column:
    """Struct column of ``SCHEMA``, computed over the whole of each text."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        import zstandard

        compress = zstandard.ZstdCompressor(level=limits.level).compress
        rows = [profile(x, limits, compress) for x in texts.to_pylist()]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "doc_ratio", "bad_chunk_share", "kept"]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run.asNondeterministic()(text)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id, the word statistics and ``kept``.

    Null and empty texts have no words and fail; repeated rows each get a row;
    null ids stay null; an empty table gives an empty result. Other columns of
    ``docs`` are not looked at, whatever their names.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", quality(F.col("text"), limits).alias("q")).select("doc_id", "q.*")


def filter_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns as they were.

    Null and empty texts go; repeated rows are judged alike; an empty table gives
    an empty result; extra columns stay, whatever their names.
    """
    ship(docs.sparkSession)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), quality(F.col("text"), limits).alias("q"))
    return marked.filter("q.kept").select("row.*")
