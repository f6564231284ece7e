"""The pipeline's near-duplicate stage against brute force."""

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from lexistrata.llm import neardup


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_keep(rows):
    """Indices of kept rows."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or (x | y and Fraction(len(x & y), len(x | y)) >= Fraction(4, 5)):
                label[root(i)] = root(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        key = (d is None, d or 0, neardup.class_of(t), t or "")
        best[root(i)] = min(best.get(root(i), (key, i)), (key, i))
    return sorted(i for _, i in best.values())


def near_copies():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([12, 60, 150, 400]))]
        for _ in range(10):
            x = list(base)
            for _ in range(rnd.randrange(1 + len(x) // 25)):
                x[rnd.randrange(len(x))] = word()
            texts.append(" ".join(x))
            if rnd.random() < 0.3:
                base = x
    line = " ".join(word() for _ in range(20))
    texts += [f"{line} " + " ".join(word() for _ in range(60)) for _ in range(30)]
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)] + ["", None, "a b", "A  b", "a b c", texts[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("rows_at_once", "settings"), [(20_000, neardup.Settings()), (50, neardup.Settings(hubs=1, growth=2, block=5, sample=30, most_common=40))])
def test_stage_matches_brute_force(spark, monkeypatch, rows_at_once, settings):
    monkeypatch.setattr(neardup, "_ROWS_AT_ONCE", rows_at_once)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [rows[i] for i in plain_keep(rows)]
    got = neardup.keep_first(docs, settings)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want
    assert 60 < len(want) < 150


def test_prefixes_meet():
    rnd = np.random.default_rng(3)
    common = np.sort(rnd.integers(0, 1000, 50))
    for _ in range(500):
        x = np.unique(rnd.integers(0, 1000, rnd.integers(1, 60)))
        y = np.unique(np.concatenate([x[rnd.random(len(x)) < 0.95], rnd.integers(0, 1000, rnd.integers(0, 4))]))
        if len(y) and neardup.similar(x, y):
            assert set(neardup.prefix(x, common)) & set(neardup.prefix(y, common))
            apart = np.bitwise_count(np.frombuffer(neardup.bitmap(x, 8), np.uint64) ^ np.frombuffer(neardup.bitmap(y, 8), np.uint64)).sum()
            assert apart <= len(set(x) ^ set(y))


def test_rows_of_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (7, a), (7, b), (7, b.upper()), (None, c), (None, c), (None, a), (9, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted((rows[i][0] or 0, rows[i][1]) for i in plain_keep(rows)) == sorted([(1, a), (7, b.upper()), (0, c), (9, "short one")])


def test_one_large_group_of_near_copies(spark):
    """A group that is one bucket, dealt out in blocks; few of its members are similar, so that all rounds are needed."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for k in range(120):
        x = list(base)
        for i in rnd.sample(range(15, 40), k % 5):
            x[i] = f"x{k}_{i}"
        texts.append(" ".join(x))
    rows = list(enumerate(texts)) + [(1000 + i, texts[i % 7]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [rows[i] for i in plain_keep(rows)]
    got = neardup.keep_first(docs, neardup.Settings(hubs=1, growth=4, block=20))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want
    assert 1 < len(want) < 120


@pytest.mark.parametrize("at_once", [50_000, 7])
def test_wide_fingerprint(monkeypatch, at_once):
    monkeypatch.setattr(neardup, "_SHINGLES_AT_ONCE", at_once)
    rnd = np.random.default_rng(1)
    for _ in range(50):
        n = int(rnd.integers(10, 200))
        x = np.unique(rnd.integers(-(1 << 62), 1 << 62, n))
        y = np.unique(np.concatenate([x[: max(9, n * 9 // 10)], rnd.integers(-(1 << 62), 1 << 62, n // 10)]))
        a, b = (np.frombuffer(neardup.fingerprint(v, 4), np.uint64) for v in (x, y))
        assert len(a) == 4 and np.bitwise_count(a ^ b).sum() <= 96 if neardup.similar(x, y) else True
        salts, full = neardup.references(4), (1 << 64) - 1

        def mixed(h, salt):
            z = ((h & full) ^ salt) * 0x9E3779B97F4A7C15 & full
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & full
            return z ^ (z >> 31)

        hashes = [[mixed(int(h), s).to_bytes(8, "little") for h in x] for s in salts]
        want = b"".join(bytes(sum(128 >> k for k in range(8) if 2 * sum(h[i] >> (7 - k) & 1 for h in of) > len(x)) for i in range(8)) for of in hashes)
        assert neardup.fingerprint(x, 4) == want
