"""Tables laid out for their queries, and the library's snapshots and backups."""

import threading

import pytest
from lexistrata.operators import facets, library, sessions
from lexistrata.schema import corpus_from_documents
from lexistrata.sources import layout, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_exchange(spark):
    rows = [(i, f"word {i} text", "en" if i % 3 else "es", f"s{i % 5}", 0) for i in range(400)]
    corpus = corpus_from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    names = layout.write_layout(corpus, "laid", bucket_bytes=2000)
    by_session, by_speaker = layout.by_session(spark, names), layout.by_speaker(spark, names)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, want in ((sessions.positions(by_session), sessions.positions(corpus)), (facets.speakers(by_speaker), facets.speakers(corpus))):
            assert "Exchange" not in plan(got) and "Exchange" in plan(want)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by_session.count() == 400 and "speech" in by_session.columns
    found = layout.column_statistics(spark, names["sessions"], "party")
    assert found["distinct_count"] == "5" and found["num_nulls"] == "0"
    assert layout.column_statistics(spark, names["speakers"], "nwords")["min"] == "3"
    assert layout.write_layout(corpus.filter("id < 0"), "laid").keys() == names.keys()
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/library"
    s = store.Store(spark, path)
    assert s.read()[0] == 0 and s.read()[1]["items"].count() == 0
    version, tables = s.read()
    s.commit(version, {"collections": library.create(tables["collections"], "one")})
    with pytest.raises(store.Conflict):
        s.commit(version, {"collections": library.create(tables["collections"], "lost")})
    errors = []

    def add(k):
        try:
            mine = store.Store(spark, path)
            ids = spark.createDataFrame([(k, 0)], "id long, k int")
            mine.change(lambda t: {"items": library.add_items(t["items"], 1, "c", ids)})
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, tables = s.read()
    assert not errors and version == 6 and {r.id for r in tables["items"].collect()} == set(range(5)) and sorted(r.position for r in tables["items"].collect()) == list(range(5))
    assert [r.name for r in tables["collections"].collect()] == ["one"]
    assert s.read(2)[1]["items"].count() == 1
    assert s.prune(2) >= 3 and s.read()[1]["items"].count() == 5 and s.prune(2) == 0


def test_backup_comes_back(spark, tmp_path):
    make = lambda name, rows: spark.createDataFrame(rows, store.SCHEMAS[name])
    tables = {
        "collections": make("collections", [(3, "Ñ \"x\"", "d", "red"), (7, "two", "", "blue")]),
        "items": make("items", [(3, "c", 10, "a\nb", ["t", "ü"], 2), (3, "c", 11, "", [], 5), (7, "e", 10, "", [], 0)]),
        "searches": make("searches", [(1, "s", "c", "a + b", 3), (2, "t", "c", "x", None)]),
    }
    path = str(tmp_path / "backup")
    store.backup(tables).write.text(path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    here = {name: make(name, rows) for name, rows in (("collections", [(5, "old", "", "")]), ("items", [(5, "c", 1, "", [], 0)]), ("searches", [(4, "u", "c", "", 5)]))}
    got = store.restore(lines, here, "z")
    assert sorted(map(tuple, got["collections"].collect())) == [(5, "old", "", ""), (6, "Ñ \"x\"", "d", "red"), (7, "two", "", "blue")]
    assert sorted((r.collection_id, r.corpus, r.id, r.note, r.tags, r.position) for r in got["items"].collect()) == [(5, "c", 1, "", [], 0), (6, "c", 10, "a\nb", ["t", "ü"], 2), (6, "c", 11, "", [], 5), (7, "e", 10, "", [], 0)]
    assert sorted(map(tuple, got["searches"].collect())) == [(4, "u", "c", "", 5), (5, "s", "c", "a + b", 6), (6, "t", "c", "x", None)]
    again = store.restore(store.backup(tables), {name: make(name, []) for name in tables}, "z")
    assert [again[n].count() for n in ("collections", "items", "searches")] == [2, 3, 2]


def test_backups_that_are_wrong(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in store.SCHEMAS.items()}
    head = '{"kind":"header","format":"lexistrata-backup/1"}'
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    for bad in (lines('{"kind":"header","format":"other"}'), lines(), lines(head, "{oops"), lines(head, '{"kind":"item","id":1,"collection_id":2}'), lines(head, '{"kind":"collection"}')):
        with pytest.raises(ValueError):
            store.restore(bad, empty, "c")
    some = lines(head, '{"kind":"collection","id":9}', '{"kind":"item","id":1,"collection_id":9}', '{"kind":"item","id":1,"collection_id":9,"position":3}', '{"kind":"item","id":2,"collection_id":9}', '{"kind":"search","query":"q","collection_id":8}')
    got = store.restore(some, empty, "c")
    assert got["collections"].first().name == "Untitled" and sorted((r.id, r.position, r.corpus) for r in got["items"].collect()) == [(1, 3, "c"), (2, 4, "c")]
    assert tuple(got["searches"].first()) == (1, "q", "c", "q", -1)
    assert got["searches"].join(library.live_searches(got["searches"], got["collections"]).filter("NOT live").select("id"), "id").count() == 1
