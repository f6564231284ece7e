"""Collocations, license scans and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexistrata.llm import collocations, licenses, resample
from lexistrata.llm.words import plain_words

ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t.,;", "en"), (4, "¿Qué? 日本語 😀 日本語 😀", None), (5, "word " * 30_000, "en"), (6, "x" * 200_000, "en"), (7, "same text here", "fr"), (7, "same text here", "fr"),
    (None, "no id", "und"), (8, "Licensed under CC BY-NC 4.0. Under the terms of the MIT License", ""), (9, "a a a a. a a", "en"),
]


@pytest.fixture
def docs(spark):
    """Odd rows, with extra columns whose names clash with results."""
    rows = [(i, t, x, 9, 1.5, "z", 2, "p") for i, t, x in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, score double, labels string, rank int, phrase string").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.filter("doc_id < 0")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- collocations


def plain_collocations(rows, s):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, s.longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    by_lang = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < s.least:
            continue
        inside = any(x == lang and len(q) > len(p) and b >= s.least and 100 * b >= s.percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in f.items())
        if not inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in by_lang.items() for k, (score, a, p, left, right) in enumerate(sorted(found)[: s.first])}


@pytest.mark.parametrize(("shard", "first", "percent"), [(40, 2000, 100), (4000, 7, 60)])
def test_collocations_match_plain(spark, shard, first, percent):
    rng = random.Random(5)
    words = ["a", "B", "the", "THE", "é", "née", "x-y", "日本", "."] + [f"w{k}" for k in range(12)]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words[: 4 + k % 18]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(60)))
        rows.append((text if k % 17 else None, rng.choice(["en", "fr", None, "und"])))
    s = collocations.Settings(least=4, first=first, percent=percent, shard=shard)
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5), s).collect()}
    want = plain_collocations(rows, s)
    assert got == want and len(want) > 20


def test_collocations_on_odd_rows(docs, empty):
    s = collocations.Settings(least=2, shard=1000)
    got = {tuple(r) for r in collocations.collocations(docs, s).collect()}
    assert got == plain_collocations([(t, x) for _, t, x in ODD], s)
    assert collocations.collocations(empty, s).collect() == []


def test_exact_score_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**11 + 7, 10**14 + 9, 4 * 10**11 + 1, 5 * 10**11 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations.exact_score("a", "n", "l", "r")).first()
    assert row[0] == 1000 * a * n // (left * right)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 300), max_size=200), st.sets(st.integers(0, 300), max_size=20))
def test_bits_answer_like_sets(x, y):
    a, b = (collocations.Bits.of(np.array(sorted(v), np.int64), 320) for v in (x, y))
    assert a.count() == len(x) and set(a.places().tolist()) == x
    assert set(a.shifted().places().tolist()) == {v + 1 for v in x}
    assert set(a.meet(b).places().tolist()) == set(b.meet(a).places().tolist()) == x & y


@pytest.mark.parametrize("kinds", [3, 40, 400])
def test_shard_counts_phrases_over_allowed_pairs(kinds):
    """With words that are all packed, some of them, and none."""
    rng = np.random.default_rng(kinds)
    numbers = np.where(rng.random(6000) < 0.1, 0, 1 + (kinds * rng.random(6000) ** 3).astype(np.int64)) * 7
    allowed = {(a, b) for a in np.unique(numbers).tolist() for b in np.unique(numbers).tolist() if a and b and (a + b) % 3}
    for pairs in (None, allowed):
        want = Counter()
        for k in (2, 3, 4):
            for i in range(len(numbers) - k + 1):
                p = tuple(numbers[i : i + k].tolist())
                if all(p) and all(pairs is None or x in pairs for x in zip(p, p[1:], strict=False)):
                    want[p] += 1
        shard = collocations.Shard(numbers)
        keys = None if pairs is None else np.array(sorted(a << 32 | b for a, b in pairs))
        got = [(tuple(shard.words[p].tolist()), int(n)) for codes, counts in shard.phrases(keys, 4) for p, n in zip(codes, counts, strict=True)]
        assert len(got) == len(dict(got)) and dict(got) == want


# --- licenses


def pattern(template):
    out = ""
    for part in re.split(r"(<<[^>]*>>)", template):
        if m := re.fullmatch(r"<<var most=(\d+)(?: match=(.*))?>>", part):
            out += f"(?: {m[2] or '[^ ]+'}){{1,{m[1]}}}"
        else:
            out += {"<<optional>>": "(?:", "<<end>>": ")?"}.get(part) or "".join(" " + w.decode() for w in plain_words(part))
    return out


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split()]
    base = {label for _, label in places}
    joined = " " + " ".join(words) + " "
    labels = base | {label for label, t in licenses.TEMPLATES if re.search(pattern(t) + " ", joined)}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def sample(template, rng):
    """A text of a template: optional regions in or out, replaceable ones filled, other case and punctuation."""
    out, keep = [], [True]
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif part == "<<end>>":
            keep.pop()
        elif keep[-1] and (m := re.match(r"<<var most=(\d+)", part)):
            out += [str(rng.randrange(9)) for _ in range(rng.randint(1, int(m[1])))]
        elif keep[-1]:
            out += [w.decode() for w in plain_words(part)]
    return "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", "\n", ", ", "  "]) for w in out)


def test_licenses_match_plain(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t, _ in ODD]
    for k, (_, template) in enumerate(licenses.TEMPLATES * 6):
        text = sample(template, rng)
        if k % 3 == 1:  # a mandatory word of it changed or gone
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["", "other"])
            text = " ".join(words)
        rows.append((100 + k, rng.choice(["", "Text before. ", "the mit "]) + text + rng.choice(["", " and after", text])))
    for k in range(100):
        rows.append((1000 + k, " ".join(rng.choice("gnu general public license apache cc by mit under the terms of licensed version 2 v3 or any later".split()) for _ in range(rng.randrange(80)))))
    got = [(r[0], *tuple(r)[1:7]) for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_licenses(t)) for i, t in rows), key=repr)
    assert sum("text" in r[6] or "header" in r[6] for r in got) > 10


def test_license_score_and_whole_texts():
    for label, t in licenses.TEMPLATES:
        text = sample(t, random.Random(1))
        assert label in licenses.automaton().accepts_whole(text)
        assert label not in licenses.automaton().accepts_whole(text + " 日本語")
    assert licenses.scan("nothing here")[3] == 0.0 and licenses.scan(None) == (0, [], [], 0.0)
    assert licenses.scan("the MIT License")[3] == 2 / 7
    assert licenses.scan("Released under the MIT License.")[1:] == ([("mit", 3)], [("mit-notice", 1, 5)], 4 / 9)


def test_licenses_on_odd_rows(docs, empty):
    rows = licenses.find_licenses(docs).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.labels for r in rows if r.doc_id == 8} == {"cc-by,cc-notice,mit,mit-notice"}
    assert licenses.find_licenses(empty).collect() == []


def test_automaton_starts_anew_and_rejects_bad_marks():
    small = licenses.Automaton.of([("x", "one <<var most=3>> two"), ("y", "<<optional>>zero<<end>> one")])
    small.most = 1
    words = b"zero one a two one two two".split()
    assert small.scan(words, range(len(words))) == [(1, 0, 2), (0, 1, 6), (1, 4, 5)]
    for bad in ("<<optional>>a<<end>>", "a <<what>>", "a <<optional>>b"):
        with pytest.raises(ValueError):
            licenses.Automaton.of([("x", bad)])


# --- resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resample(rows, target, s):
    code = lambda x: zlib.crc32(x.encode()) % s.buckets
    source, wanted = (Counter(code(x) for t in texts for x in plain_features(t)[1]) for texts in ([t for _, t in rows], target))
    n_s, n_t = sum(source.values()), sum(wanted.values())
    out = []
    for i, t in rows:
        words, feats = plain_features(t)
        gains = [math.floor(1000 * math.log((wanted[code(x)] + 1) * (n_s + s.buckets) / ((source[code(x)] + 1) * (n_t + s.buckets)))) for x in feats]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((len(words) >= s.min_words, i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[0]), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[3], r[2]))
    drawn = able[: s.percent * len(able) // 100]
    rest = [(*r[1:], None) for r in out if not r[0]] + [(*r[1:], None) for r in able[len(drawn) :]]
    return sorted([(*r[1:], k + 1) for k, r in enumerate(drawn)] + rest, key=repr)


@pytest.mark.parametrize("buckets", [1, 50, 10_000, 65_536])
def test_resample_matches_plain(spark, buckets):
    rng = random.Random(buckets)
    words = [f"w{k}" for k in range(80)] + ["Été", "日本語", "A1", "-", "..."]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
    rows = [(k // 2 if k < 20 else k, make() if k % 13 else None) for k in range(300)]
    target = [make() for _ in range(9)] + [None, ""]
    s = resample.Settings(buckets=buckets)
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), s)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, target, s)


def test_resample_on_odd_rows(docs, empty):
    s = resample.Settings(min_words=1, percent=50)
    rows = [(i, t) for i, t, _ in ODD]
    for target, texts in ((docs.select("text"), [t for _, t in rows]), (empty.select("text"), [])):
        assert sorted((tuple(r) for r in resample.resample(docs, target, s).collect()), key=repr) == plain_resample(rows, texts, s)
    assert resample.resample(empty, docs, s).collect() == []
    with pytest.raises(ValueError):
        resample.write_streams(docs, resample.Settings(buckets=70_000))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=100))
def test_runs_count_like_a_counter(values):
    bucket, length = resample.runs(np.array(values, np.uint16))
    assert dict(zip(bucket.tolist(), length.tolist(), strict=True)) == Counter(values)
