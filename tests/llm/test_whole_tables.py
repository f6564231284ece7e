"""Registered queries over the whole smallest tables against plain versions."""

import zlib

import duckdb
import numpy as np
import zstandard
from lexistrata.llm import quality, queries

D = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet' ORDER BY doc_id").fetchall()


def test_quality_verdicts(spark):
    """The bands row by row: the whole text and each chunk of 4 KiB, a short rest joined to the last."""
    limits = quality.Limits()

    def outside(raw):
        low, high = [(a, b) for start, a, b in quality.BANDS if start <= len(raw)][-1]
        return not low <= len(zstandard.compress(raw, limits.level)) / len(raw) <= high

    rows = {r.doc_id: r for r in queries.op1_quality_rules(spark, D).collect()}
    for i, text in documents():
        raw = (text or "").encode()
        parts = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        if len(parts) > 1 and len(parts[-1]) < 1024:
            parts[-2:] = [parts[-2] + parts[-1]]
        bands = not raw or (not outside(raw) and sum(map(outside, parts)) <= 0.34 * len(parts))
        assert rows[i].kept == (not rows[i].base_failed and bands), i
    assert {r.kept for r in rows.values()} == {True, False}


def test_token_store_by_document(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    at, want = 0, []
    for i, text in documents():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op5_token_store(spark, D).collect()) == want
