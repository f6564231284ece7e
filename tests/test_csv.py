"""CSV records from byte ranges against Python's reader over the whole file, and hashes of chunks."""

import csv
import io
import random

import pytest
from lexistrata.schema import CSV_COLUMNS
from lexistrata.sources import corpus_csv, csv_ranges


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain(data: bytes):
    """(number, line, byte, fields) by one reader over all lines."""
    pieces = data.splitlines(keepends=True)
    reader = csv.reader(p.decode() for p in pieces)
    out, at = [], 0
    for k, fields in enumerate(reader):
        out.append((k, 1 + sum(p.endswith(b"\n") for p in pieces[:at]), sum(map(len, pieces[:at])), fields))
        at = reader.line_num
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ranges_match_one_reader(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["a", "", '"q"', '"x, y"', '"two\nlines"', '"é ""in"" quotes"', 'mid"dle', '"a\r\nb"', '"long ' + "z\n" * rng.randrange(200) + '"', "ñ" * 20, '"ab"cd'])
    data = "".join(",".join(cell() for _ in range(rng.randrange(1, 5))) + rng.choice(["\n", "\n", "\r\n", "\r", "\n\n"]) for _ in range(150)).encode()
    if seed % 2:
        data = data.rstrip(b"\r\n")
    path = tmp_path / "x.csv"
    path.write_bytes(data)
    source = csv_ranges.lines(spark, str(path))
    plan = csv_ranges.survey(source)
    got = sorted(tuple(r) for r in csv_ranges.read(source, plan).collect())
    assert [(a, b, c, list(d)) for a, b, c, d in got] == plain(data)
    assert len(plan.quoted) > 5 and any(plan.quoted.values()) and not plan.cut and plan.records == len(got)


def good(n=60, text="Hello, \"you\"\nand you"):
    rows = [("ES1", f"i{k}", "L1", "1", "1", "2010-01-02", "ord", str(k), "Sr. X", "d1", "X", "m", "P1", "D", "1", text) for k in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([CSV_COLUMNS, *rows])
    return out.getvalue().encode()


def failure(spark, tmp_path, data):
    path = tmp_path / "f.csv"
    path.write_bytes(data)
    with pytest.raises(corpus_csv.IngestError) as e:
        corpus_csv.ingest(spark, str(path))
    return str(e.value)


def test_failures_name_their_place(spark, tmp_path, small_ranges):
    data = good()
    head = data.index(b"\n") + 1
    assert corpus_csv.transform(corpus_csv.read_raw(spark, str(_write(tmp_path, data)))).count() == 60
    at = data.index(b"i40")
    line = data[:at].count(b"\n") + 1
    record = data.rindex(b"ES1", 0, at)
    assert failure(spark, tmp_path, data.replace(b"i40", b"i40,x")) == f"field_count: 1 records, the first 41 in line {line} at byte {record}: 17"
    assert failure(spark, tmp_path, data.replace(b"i40", b"i4\xff")) == f"invalid_utf8: line {line}, byte {at + 2}"
    far = data.rindex(b"Hello")
    assert failure(spark, tmp_path, data[:far] + b"\x00" + data[far:]) == f"nul_byte: line {data[:far].count(b'\n') + 1}, byte {far}"
    assert failure(spark, tmp_path, data[: data.rindex(b"and")]) == f"cut_in_quotes: record 60, line {data.count(b'\n') - 1}"
    assert failure(spark, tmp_path, data.rstrip(b"\n") + "é".encode()[:1]).startswith("cut_utf8: ")
    for bad, code in ((b",ord,x7,", "order_not_integer"), (b",ord,99999999999,", "order_out_of_range"), (b",ord," + b"1" * 4301 + b",", "order_too_long")):
        assert failure(spark, tmp_path, data.replace(b",ord,7,", bad)).startswith(f"{code}: 1 records, the first 8 in line ")
    assert failure(spark, tmp_path, data.replace(b"P1,D,1", b"P1,D,yes", 3)).startswith("flag_not_integer: 3 records, the first 1 in line 2 at byte " + str(head))


def _write(tmp_path, data):
    path = tmp_path / "w.csv"
    path.write_bytes(data)
    return path


def test_warnings(spark, tmp_path, small_ranges):
    data = b"\xef\xbb\xbf" + good().replace(b"ES1,i5,", b"\n\nES1,i5,").replace(b"2010-01-02", b"2010-13-02", 1).replace(b"P1,D", b"P9,D", 2)
    parties = spark.createDataFrame([("P1",)], "label string")
    raw, warnings = corpus_csv.examine(spark, str(_write(tmp_path, data)), parties)
    assert warnings == [("bom", 1, 0, 1), ("bad_date", 1, 1, 2), ("blank_line", 2, 6, 12), ("unknown_party", 2, 1, 2)]
    got = corpus_csv.transform(raw)
    assert got.count() == 60 and {r.id for r in got.collect()} == set(range(1, 61))


def test_chunk_hashes_name_the_changed_chunk(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    data = "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(3000)).encode()
    path = _write(tmp_path, data)
    before = csv_ranges.chunk_hashes(spark, str(path), 64).collect()
    assert {r.level for r in before} == {0, 1, 2} and sum(r.level == 2 for r in before) == 1
    old = spark.createDataFrame(before)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    assert sorted(csv_ranges.chunk_hashes(spark, str(path), 64).collect()) == sorted(before)
    at = 40_000
    path.write_bytes(data[:at] + (b"a" if data[at : at + 1] != b"a" else b"b") + data[at + 1 :])
    start = data.rindex(b"\n", 0, at) + 1
    got = csv_ranges.changed_chunks(old, csv_ranges.chunk_hashes(spark, str(path), 64)).collect()
    assert [tuple(r) for r in got] == [(start // 64, "changed")]
    assert csv_ranges.changed_chunks(old, old).collect() == []
    path.write_bytes(data + b"\n" + b"more " * 40)
    kinds = {r.kind for r in csv_ranges.changed_chunks(old, csv_ranges.chunk_hashes(spark, str(path), 64)).collect()}
    assert kinds == {"added"} or kinds == {"added", "changed"}
