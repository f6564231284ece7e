"""Series with sessions, smoothing of each measure, and exports with citations."""

import json

import pytest
from lexistrata.operators import trend
from lexistrata.sources import exports


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "2010-01-05", 1, "the the x"), (2, "2010-01-05", 1, "x"), (3, "2010-01-09", 2, "the"), (4, "2010-03-01", 3, "x y"), (5, None, 4, "the"), (6, "2010-02-02", 5, "the the the")]
    return spark.createDataFrame(data, "id long, date string, num_session int, speech string")


def test_sessions_of_months_and_years(rows):
    months = trend.with_sessions(trend.monthly(rows, trend.read_terms(["the"])), rows)
    got = {r.month: (r["count"], r.sessions, r.first, r.last) for r in months.select("month", "count", "sessions", "first", "last").collect()}
    assert got == {"2010-01": (3, 2, "2010-01-05", "2010-01-09"), "2010-02": (3, 1, "2010-02-02", "2010-02-02"), "2010-03": (0, 1, "2010-03-01", "2010-03-01")}
    year = trend.yearly(months).first()
    assert (year["count"], year.sessions, year["first"], year["last"]) == (6, 4, "2010-01-05", "2010-03-01")
    assert "sessions" not in trend.yearly(trend.monthly(rows, trend.read_terms(["the"]))).columns


def test_each_measure_is_smoothed(rows):
    months = trend.monthly(rows, trend.read_terms(["the"]))
    value = lambda m: {r.month: r[m] for r in trend.smoothed(months, 3, 3, m).collect()}
    assert value("count") == {"2010-01": 3.0, "2010-02": 2.0, "2010-03": 1.5}
    assert value("percent") == {"2010-01": 75.0, "2010-02": 60.0, "2010-03": 50.0}
    assert value("density")["2010-01"] == pytest.approx(6 / 8 * 10_000)


def test_csv_with_citation_and_mark(spark):
    table = spark.createDataFrame([(0, 7, 'a"b', ["t", "u"])], "k int, id long, note string, tags array<string>")
    lines = [r.line for r in exports.csv_lines(table, ["id", "note", "tags"], "Source", {"cite": "C 2010", "doi": "10.1/x"}, bom=True).orderBy("k").collect()]
    assert lines == ["﻿# Source", '"id";"note";"tags";"cite";"doi"', '"7";"a""b";"t, u";"C 2010";"10.1/x"']


def test_csl(spark):
    table = spark.createDataFrame([(0, 5, "Gómez Paz, Ana", "2010-03-04", 2010, 3), (1, 6, "Luis Sol", None, None, 4), (2, 7, "Rey", "1999", 1999, 1)], "k int, id long, rep_name string, date string, year int, num_session int")
    got = [json.loads(r.line) for r in exports.csl(table, "Debates", "https://x.org").orderBy("k").collect()]
    assert got[0] == {"id": "gomez-paz-ana-2010-5", "type": "speech", "author": [{"family": "Gómez Paz", "given": "Ana"}], "issued": {"date-parts": [[2010, 3, 4]]}, "event-title": "session 3", "number": "5", "container-title": "Debates", "URL": "https://x.org"}
    assert got[1]["author"] == [{"family": "Sol", "given": "Luis"}] and "issued" not in got[1]
    assert got[2]["author"] == [{"family": "Rey"}] and got[2]["issued"] == {"date-parts": [[1999]]}
