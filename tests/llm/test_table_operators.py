"""Operators over whole tables, against plain versions."""

import hashlib
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexistrata.llm import knn, packing, simhash, tokenstore, warc, wavelet
from lexistrata.llm.common import materialise
from lexistrata.llm.queries import tokenizer_path
from pyspark.sql import functions as F

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "¿Qué? 日本語 😀 <|endoftext|> !"), (5, "word " * 5_000), (6, "x" * 20_000), (7, "same text here"), (7, "same text here"), (7, "other text"), (None, "no id"), (None, None), (9, "same text here")]
_SHARED: dict = {}
EXTRA = "n_tokens int, fingerprint string, component_id string, part int, start string"


@pytest.fixture
def docs(spark):
    rows = [(i, t, 1, "f", "c", 5, "s") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture
def empty(docs):
    return docs.filter("doc_id < 0")


# --- wavelet matrix and token store


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=200))
def test_wavelet_file_answers_like_a_list(ids):
    x = np.array(ids, np.uint32)
    data = wavelet.encode_file(x, 9, {}, b"tail")
    w = wavelet.WaveletFile(io.BytesIO(data), len(data))
    assert w.all().tolist() == ids and w.tail() == b"tail"
    assert [w.access(i) for i in range(len(ids))] == ids
    for token in {ids[0], ids[-1], 299}:
        at = [i for i, t in enumerate(ids) if t == token]
        assert w.count(token) == len(at) and w.locate(token) == at
        assert w.rank(token, len(ids) // 2) == sum(i < len(ids) // 2 for i in at)
    with pytest.raises(IndexError):
        w.select(ids[0], len(ids) + 1)


def test_wavelet_over_block_borders(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    ids = np.random.default_rng(1).integers(0, 50_000, 1000).astype(np.uint32)
    data = wavelet.encode_file(ids, 16, {}, b"")
    w = wavelet.WaveletFile(io.BytesIO(data), len(data))
    assert [w.access(i) for i in range(0, 1000, 37)] == ids[::37].tolist()
    assert w.locate(int(ids[999]))[-1] == 999 and (w.all() == ids).all()
    with pytest.raises(ValueError, match="wavelet"):
        wavelet.WaveletFile(io.BytesIO(b"x" * 100), 100)


def test_token_store_round_trip(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.store_tokens(docs, tokenizer_path(), tokenstore.Settings(shard_tokens=3000)).collect())
    assert len(got) == len(ODD)
    starts = sorted((g[2], g[3]) for g in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert [g[2] for g in got] == sorted(g[2] for g in got)  # ascending ids, nulls first
    want = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in ODD)
    assert sorted(g[4] for g in got) == want
    assert tokenstore.store_tokens(empty, tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r'''stremvldSa1é!-ß"), max_size=25) | st.sampled_from(["x\x1cy z", "\x85 a\xa0b", "5×3 日本 's", "a <|endoftext|> b's", "we'll", "'re've", "can't", "n' s", "  's"]), max_size=6))
def test_texts_together_are_the_library_s(texts):
    from tokenizers import Tokenizer

    if "library" not in _SHARED:
        _SHARED.update(library=Tokenizer.from_file(tokenizer_path()), tokens=tokenstore.Tokens(tokenizer_path(), 20))
    t = _SHARED["tokens"]
    assert t.encode_all(texts) == [np.array(_SHARED["library"].encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    plain = [x for x in texts if x and not t.other(x)]
    if plain:
        raw = [x.encode() for x in plain]
        begins = tokenstore.cuts(b"".join(raw), np.cumsum([0, *map(len, raw[:-1])])).tolist()
        words = [w.encode() for x in plain for w in t.find(x)]
        assert begins == np.cumsum([0, *map(len, words[:-1])]).tolist()


def test_texts_together_encode_each_word_once():
    t = tokenstore.Tokens(tokenizer_path(), 10)
    texts = [" ".join(f"wörd{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + " "] * 30
    asked = []
    t.columns._encode = lambda words, plain=t.columns._encode: asked.extend(words.to_pylist()) or plain(words)
    t.words.tokenize = lambda word, plain=t.words.tokenize: asked.append(word) or plain(word)
    want = [np.array(t.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert t.encode_all(texts) == want
    assert len(asked) == 61  # 60 words and the blank at the end
    assert len(t.columns.words) == len(t.columns.ids) == len(t.columns.met) == 5
    assert t.encode_all(texts[:1]) == want[:1] and len(asked) == 61 + 56


# --- packing


def plain_padding(histogram, buckets):
    """Least padding by trying all boundaries."""
    from itertools import combinations

    lengths = sorted(n for n, _ in histogram)
    best = math.inf
    for k in range(1, min(buckets, len(lengths)) + 1):
        for cut in combinations(lengths[:-1], k - 1):
            best = min(best, padding(histogram, [*cut, lengths[-1]]))
    return best


def padding(histogram, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in histogram)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    rows = list(histogram.items())
    ends = packing.boundaries(rows, buckets)
    assert len(ends) <= buckets and ends == sorted(ends) and ends[-1] == max(histogram)
    assert padding(rows, ends) == plain_padding(rows, buckets)


def test_packing_keeps_every_document_within_the_budget(docs, empty):
    s = packing.Settings(buckets=3, budget=5000)
    rows = packing.pack(docs, tokenizer_path(), s).collect()
    assert len(rows) == len(ODD)
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_limit - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for members in batches.values():
        assert sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_limit <= s.budget
    # only the last batch of a bucket may have room
    for b in {k[0] for k in batches}:
        sizes = [len(batches[b, i]) for i in range(sum(k[0] == b for k in batches))]
        assert len(set(sizes[:-1])) <= 1
    assert packing.pack(empty, tokenizer_path()).count() == 0
    # the written batches hold the library's ids
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_ids(docs, tokenizer_path(), s).collect()
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ODD)
    assert sorted(np.frombuffer(bytes(r.ids), "<u2").tolist() for r in rows) == want
    batch = [r for r in rows if (r.bucket, r.batch) == (rows[0].bucket, rows[0].batch)]
    matrix = packing.padded(batch, tokenizer_path())
    assert matrix.shape == (len(batch), batch[0].bucket_limit) and matrix.size <= max(s.budget, batch[0].bucket_limit)
    assert all(matrix[r.slot, : r.n_tokens].tobytes() == bytes(r.ids) and not matrix[r.slot, r.n_tokens :].any() for r in batch)
    assert packing.boundaries([], 3) == []


def test_packing_encodes_each_word_of_a_batch_once(monkeypatch):
    t = tokenstore.Tokens(tokenizer_path(), 10)
    monkeypatch.setitem(tokenstore._TOKENIZERS, tokenizer_path(), t)
    monkeypatch.setattr(packing.F, "arrow_udf", lambda kind: lambda run: run)
    asked = []
    t.columns._encode = lambda words, plain=t.columns._encode: asked.extend(words.to_pylist()) or plain(words)
    t.words.tokenize = lambda word, plain=t.words.tokenize: asked.append(word) or plain(word)
    texts = [None, "", *[" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))] * 30, "", None]
    want = [[*t.library.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    got = packing.encoded(pa.array(texts), tokenizer_path()).to_pylist()
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in got] == want
    assert [r["n_tokens"] for r in got] == list(map(len, want))
    assert len(asked) == 60


# --- near-duplicates


def plain_fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\n\x0bcd", max_size=60))
def test_fingerprint_matches_plain(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_match_plain(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    groups = plain_components(fps)
    first = {}
    for r, g in zip(rows, groups, strict=True):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{f:016x}", first[g]) for r, f, g in zip(rows, fps, groups, strict=True))
    assert sorted(map(tuple, simhash.near_duplicates(table).collect())) == want


@pytest.mark.parametrize("block", [2048, 20])
def test_links_keep_every_component(spark, block):
    """Clusters, chains and noise, with buckets dealt out in blocks and without."""
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            flips = rnd.sample(range(64), rnd.randint(1, 5))
            x ^= sum(1 << b for b in flips)
            if rnd.random() < 0.5:
                x ^= sum(1 << b for b in flips)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(materialise(distinct, "d"), len(fps), simhash.Settings(block=block))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges.collect())
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    ours, seen = {}, {}
    for x, g in zip(signed, plain_components(fps), strict=True):
        ours.setdefault(g, set()).add(x)
        seen.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, seen.values()))


def test_more_bands_for_more_fingerprints():
    few, many = simhash._bands(1000, 4, 256), simhash._bands(10**8, 4, 256)
    assert len(few) == 5 and len(many) == 15
    rnd = random.Random(1)
    for masks in (few, many):
        for _ in range(500):
            x = rnd.getrandbits(64)
            y = x ^ sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(x & m == y & m for m in masks)


def test_near_duplicates_on_odd_rows(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    blank = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert blank == {1}
    assert simhash.near_duplicates(empty).count() == 0


# --- archives


PAGES = [(1, "http://a.example.com/x", "p" * 200), (2, "http://a.example.com/x", "p" * 200), (2, "http://a.example.com/x", "p" * 200), (3, None, "short"), (4, "bad url", "short"), (5, "http://b.org/\r\nevil", None), (6, "https://A.example.com:80/y?q#f", "é" * 120), (None, "http://c.net", "p" * 200), (8, "", "")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, key string, size int").repartition(3)
    rows = warc.archive(pages, warc.Settings(file_bytes=300, block_lines=2)).collect()
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        first = min(same) if len(raw) >= 100 else page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if page == first else "revisit", None if page == first else first))
    none = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(none, want)) == sorted(map(none, map(tuple, rows)))
    assert warc.archive(pages.filter("page_id < 0")).count() == 0


def test_index_finds_one_page_among_many(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p/{i}", f"text {i} " * 30) for i in range(500)], "page_id long, url string, html string")
    captures, folder = warc.write(pages)
    files = warc.index(captures, folder, warc.Settings(block_lines=16))
    asked = pages.filter("page_id IN (3, 77, 499)").unionAll(spark.createDataFrame([(3, "http://nowhere.example/", "")], pages.schema))
    rows = warc.lookup(asked.select("page_id", "url"), files, folder).collect()
    assert sorted(r.page_id for r in rows) == [3, 77, 499]
    assert files == sorted(files)


def test_surt_keys():
    assert warc.surt("https://www.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    assert warc.surt("http://x.org") == "org,x)/" and warc.surt(None) == "-)"


# --- exact top-k


def plain_top(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "groups", "ties", "large"])
def test_top_k_matches_plain(spark, kind):
    rnd = random.Random(kind)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(600):
        c = rnd.choice(centres)
        v = [x * (1e9 if kind == "large" else 1) + rnd.gauss(0, 0.1) for x in c]
        if kind == "ties":
            v = [float(rnd.randint(0, 1)) for _ in range(8)]
        rows.append((i, v))
    rows += [(50, rows[50][1]), (700, None), (750, [None, 1.0]), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (None, rows[0][1]), (900, [1.0, 2.0]), (901, [1.0, 3.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, g int").repartition(3)
    s = knn.Settings(pivots=8, group_queries=3, block_rows=100) if kind == "groups" else knn.Settings(pivots=8)
    got = sorted(map(tuple, knn.top_k(table, F.col("vec_id") % 50 == 0, s).collect()))
    want = plain_top(rows)
    if kind == "large":
        want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in want]
        assert [(q, r, score) for q, r, _, score in got] == [(q, r, score) for q, r, _, score in want]
    else:
        assert got == want
    assert knn.top_k(table.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
