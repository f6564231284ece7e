"""Parsers, sources, sinks, graphs and detectors on small hand-made cases."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexistrata import registry
from lexistrata.functions import text
from lexistrata.operators import document, expressions, graph, index, library, mentions, phrases, replies, search, sessions, speakers, temporal, trend, views
from lexistrata.plans.query import QueryError, fold_text, parse
from lexistrata.schema import CORPUS, CSV_COLUMNS, corpus
from lexistrata.sources import corpus_csv, exports
from lexistrata.streaming import events as streams
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


# --- query language


@pytest.mark.parametrize(
    ("query", "read"),
    [
        ("casa perro", "casa perro"), ("casa + perro", "casa perro"), ("a|b c", "a | (b c)"), ('"de la" casa', '"de la" casa'), ("art.26", '"art 26"'), ("la casa", "casa"),
        ("(la) casa", "la casa"), ("la el", "la el"), ("((a | b)) c", "(a | b) c"), ("«de la»", '"de la"'), ("CAFÉ", "cafe"), ("a (b c)", "b c"), ("x --", "x"),
    ],
)
def test_query_reads(query, read):
    assert parse(query).text() == read


@pytest.mark.parametrize(
    ("query", "code"),
    [("", "nothing_to_search"), ("--", "nothing_to_search"), ("a*", "asterisk"), ("a AND b", "operator_word"), ('"a', "unclosed_quotes"), ('""', "empty_quotes"), ("()", "empty_parentheses"), ("(a", "unbalanced"), ("a)", "unbalanced"), ("| a", "operator_place"), ("a |", "operator_at_end"), ("a || b", "operator_place"), ("a + + b", "operator_place")],
)
def test_query_errors(query, code):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert e.value.code == code


def test_query_notices():
    q = parse("la casa --")
    assert q.omitted == ["la"] and q.ignored == ["--"] and q.terms() == [("casa",)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab "|+()*', max_size=12))
def test_query_reads_or_raises(query):
    try:
        q = parse(query)
    except QueryError as e:
        assert 0 <= e.at <= len(query)
    else:
        assert parse(q.text()).text() == q.text()


def test_terms():
    assert trend.read_term("ing*").kind == "prefix" and trend.read_term('"de la"').kind == "phrase" and trend.read_term("casas", True).kind == "prefix"
    assert trend.read_term('"casas"', True).kind == "word" and trend.read_term("de la", True).notices
    for raw, code in (("ab*", "short_prefix"), ("a*b", "asterisk"), ("", "empty"), ('"x', "quotes"), ("a OR b", "operator"), ("--", "no_words"), ("a b*", "asterisk")):
        with pytest.raises(QueryError) as e:
            trend.read_term(raw)
        assert e.value.code == code
    with pytest.raises(QueryError):
        trend.read_terms([f"w{i}" for i in range(13)])


def test_hits_and_snippets():
    assert search.hit_ranges("De La casa de la casa", [("de", "la"), ("la", "casa")]) == [(0, 10), (11, 21)]
    line = search._snip("x " * 50 + "Casa grande " + "y " * 50, [("casa",)], 10)
    assert "<<<Casa>>>" in line and line.startswith("… ") and line.endswith(" …")
    assert search._snip("", [("a",)], 5) == ""


def test_suggestions_and_thinning(spark):
    v = spark.createDataFrame([("casa", 9, 9), ("caso", 3, 3), ("perro", 1, 1)], "token string, docs long, count long")
    assert trend.suggestions(v, "cass") == ["caso", "casa"] or trend.suggestions(v, "cass") == ["casa", "caso"]
    assert trend.suggestions(v, "c") == [] and trend.suggestions(v, "zzzz") == []
    assert trend.without_hits(v, trend.read_term("cass")) == {"alternatives": trend.suggestions(v, "cass")}
    phrase = trend.without_hits(v, trend.read_term('"casa pero"'))
    assert phrase == {"missing": ["pero"], "alternatives": {"pero": ["perro"]}}
    assert trend.without_hits(v, trend.read_term("casilla*")) == {"prefix": "cas", "forms": [("casa", 9), ("caso", 3)]}
    assert trend.without_hits(v, trend.read_term("zzzz*")) == {}
    m = spark.createDataFrame([(f"m{i}", f"20{i:02d}-01-01", 1 if i < 2 else 2) for i in range(10)], "id string, date string, rank int")
    kept = trend.thin(m, 5).collect()
    assert len(kept) == 5 and sum(r["rank"] == 1 for r in kept) == 2


# --- text


def test_text_columns(spark):
    row = spark.createDataFrame([("  Ñandú, CAFÉ_bar 12\tfin ", "=1+2", "<a & \"b\">", "JUAN DE LA CRUZ")], "a string, b string, c string, d string")
    got = row.select(text.index_tokens(F.col("a")), text.word_count(F.col("a")), text.slug(F.col("a")), text.guard_formula(F.col("b")), text.escape_markup(F.col("c")), text.title_name(F.col("d"))).first()
    assert list(got) == [["nandu", "cafe", "bar", "12", "fin"], 4, "nandu-cafe-bar-12-fin", "'=1+2", "&lt;a &amp; &quot;b&quot;&gt;", "Juan de la Cruz"]
    spans = row.select(text.spans(F.lit("uno dos. tres, cuatro\ncinco"))).first()[0]
    assert spans == [["uno", "dos"], ["tres"], ["cuatro"], ["cinco"]]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_fold_is_stable(s):
    assert fold_text(fold_text(s)) == fold_text(s)


# --- sources and sinks


def _csv(path, rows, header=CSV_COLUMNS, sep=","):
    lines = [sep.join(header)] + [sep.join('"' + str(x).replace('"', '""') + '"' for x in r) for r in rows]
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


ROWS = [
    ("ES1", "a", "L1", "", "1A", "2010-01-02", "ord", "0", "", "", "", "", "", "", "", 'Order "of" the day\nsecond line'),
    ("ES1", "b", "L1", "1", "", "2010-01-02", "ord", "1", "Sr. GÓMEZ", "d9", "Gómez", "m", "P1", "X", "1", "Good  morning"),
    ("ES0", "c", "", "1", "", "", "ord", "", "", "d2", "", "f", "P2", "", "", "x"),
    ("ES1", "d", "L1", "1", "", "2010-01-03", "ord", "2", "Sra. PAZ", "d2", "Paz", "f", "P2", "", "0", ""),
]


def _csv_bytes(folder):
    with open(_csv(folder / "source.csv", ROWS), "rb") as f:
        return f.read()


def test_csv_ingest(spark, tmp_path):
    got = corpus_csv.ingest(spark, _csv(tmp_path / "c.csv", ROWS))
    assert got.columns == CORPUS.fieldNames()
    rows = got.orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4] and [r.num_session for r in rows] == [1, 1, 2, 1] and [r.rep_id for r in rows] == [None, 0, 1, 1]
    assert [r.speaker for r in rows] == ["SUMARIO", "Sr. GÓMEZ", "SUMARIO", "Sra. PAZ"] and [r.dm_speech for r in rows] == [0, 1, 0, 0]
    assert rows[0].speech == 'Order "of" the day\nsecond line' and rows[0].nwords == 6 and rows[2].date is None and rows[2].legislature == "Sin identificar" and rows[1].sex == "M"
    corpus_csv.write_corpus(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    found = index.build(got, str(tmp_path / "index"))
    assert found.match("order").count() == 1 and found.match('"of the"').count() == 1 and found.match('"the of"').count() == 0 and found.match("nothing").count() == 0
    assert [(r["token"], r["docs"], r["count"]) for r in found.vocabulary("ord").collect()] == [("order", 1, 1)]
    import hashlib

    raw = (tmp_path / "c.csv").read_bytes()
    assert [(r.length, r.sha256) for r in corpus_csv.checksum(spark, str(tmp_path / "c.csv")).collect()] == [(len(raw), hashlib.sha256(raw).hexdigest())]


def test_index_of_an_empty_corpus(spark, tmp_path):
    none = spark.createDataFrame([], CORPUS)
    found = index.build(none, str(tmp_path / "index"))
    assert found.scores("a | b").count() == 0 and found.vocabulary().count() == 0


def test_replacement_characters_are_valid(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_bytes(_csv_bytes(tmp_path).replace(b"second line", "second \ufffd line".encode()))
    assert corpus_csv.ingest(spark, str(good)).count() == 4
    bad = tmp_path / "bad.csv"
    bad.write_bytes(_csv_bytes(tmp_path).replace(b"second line", b"second \xff line"))
    with pytest.raises(corpus_csv.IngestError) as e:
        corpus_csv.ingest(spark, str(bad))
    assert e.value.code == "invalid_utf8"


def test_csv_errors(spark, tmp_path):
    cases = {"empty_file": b"", "zip_file": b"PK\x03\x04zzz", "sqlite_file": b"SQLite format 3\x00", "nul_byte": b"a\x00b", "wrong_separator": b";".join(c.encode() for c in CSV_COLUMNS), "wrong_header": b"a,b,c\n1,2,3"}
    for code, data in cases.items():
        p = tmp_path / code
        p.write_bytes(data)
        with pytest.raises(corpus_csv.IngestError) as e:
            corpus_csv.sniff(spark, str(p))
        assert e.value.code == code
    assert corpus_csv.sniff(spark, _csv(tmp_path / "ok.csv", ROWS)) == []
    bad = [(*ROWS[1][:7], "one", *ROWS[1][8:])]
    with pytest.raises(corpus_csv.IngestError, match="order_not_integer"):
        corpus_csv.ingest(spark, _csv(tmp_path / "order.csv", bad))
    with pytest.raises(corpus_csv.IngestError, match="field_count"):
        corpus_csv.ingest(spark, _csv(tmp_path / "width.csv", [ROWS[1][:9]]))


def test_bundle_round_trip(spark):
    c = corpus(spark, D)
    items = spark.createDataFrame([(5, "note", ["a"], 1), (3, "", [], 0)], "id long, note string, tags array<string>, position int")
    doc = exports.bundle({"name": "mine", "description": "", "color": ""}, items, c, "ES")
    collection, back = exports.read_bundle(spark, doc, "ES")
    assert collection["name"] == "mine (imported)" and [(r.id, r.note, r.tags) for r in back.orderBy("position").collect()] == [(3, "", []), (5, "note", ["a"])]
    for wrong in ("{", json.dumps({"format": "x"}), doc.replace('"ES"', '"BR"'), doc.replace('"speech_id": 5', '"speech_id": "5"')):
        with pytest.raises(ValueError, match="."):
            exports.read_bundle(spark, wrong, "ES")


def test_sinks(spark, tmp_path):
    c = corpus(spark, D)
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "k long, id long")
    rows = exports.rows_for(c, ids)
    lines = exports.csv_lines(rows, ["id", "rep_name"], "cite")
    exports.write_csv(lines, str(tmp_path / "x"))
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "x").glob("part-*")))
    assert body == b'# cite\r\n"id";"rep_name"\r\n"7";"rep7"\r\n"3";"rep3"\r\n"7";"rep7"\r\n'
    assert exports.bibtex(rows).filter("k = 1").first().line.startswith("@misc{rep3-2010-3,")
    assert json.loads(exports.json_rows(rows, ["id", "party"]).filter("k = 1").first().line)["id"] == 3
    nodes = spark.createDataFrame([("a", "A & B"), ("b", "C")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", 1.5)], "a string, b string, weight double")
    assert 'label="A &amp; B"' in exports.gexf(nodes, edges) and 'defaultedgetype="directed"' in exports.gexf(nodes, edges, True)


# --- graphs

#: The edges of the public karate-club graph, from node 0.
KARATE = "0-1 0-2 0-3 0-4 0-5 0-6 0-7 0-8 0-10 0-11 0-12 0-13 0-17 0-19 0-21 0-31 1-2 1-3 1-7 1-13 1-17 1-19 1-21 1-30 2-3 2-7 2-8 2-9 2-13 2-27 2-28 2-32 3-7 3-12 3-13 4-6 4-10 5-6 5-10 5-16 6-16 8-30 8-32 8-33 9-33 13-33 14-32 14-33 15-32 15-33 18-32 18-33 19-33 20-32 20-33 22-32 22-33 23-25 23-27 23-29 23-32 23-33 24-25 24-27 24-31 25-31 26-29 26-33 27-33 28-31 28-33 29-32 29-33 30-32 30-33 31-32 31-33 32-33"


def test_leiden_on_known_graphs():
    edges = [(*map(int, e.split("-")), 1.0) for e in KARATE.split()]
    assert len(edges) == 78
    part, q = graph.leiden(34, edges)
    assert round(q, 4) >= 0.4188 and len(set(part)) == 4
    assert graph.leiden(34, edges) == (part, q)
    ring = [(5 * c + i, 5 * c + j, 1.0) for c in range(8) for i in range(5) for j in range(i)] + [(5 * c, (5 * c + 5) % 40, 1.0) for c in range(8)]
    part, _ = graph.leiden(40, ring)
    assert len(set(part)) == 8 and all(len({part[5 * c + i] for i in range(5)}) == 1 for c in range(8))
    assert graph.leiden(0, []) == ([], 0.0) and graph.leiden(2, [])[0] == [0, 1]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in graph.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize(("n", "few"), [(1000, 100_000), (300, 20)])
def test_components_of_a_long_path(spark, n, few):
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, ids[1:], strict=False)) + [(2000, 2000), (3001, 3000), (None, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "a long, b long"), few).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 2000: 2000, 3000: 3000, 3001: 3000}


def test_components_of_all_lines(spark):
    up = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            x = y
        return x

    for r in spark.read.parquet(f"{D}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        x, y = root(2 * r.l_orderkey), root(2 * r.l_partkey + 1)
        up[max(x, y)] = min(x, y)
    got = registry.queries()["connected_components"](spark, D).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in up} and len(got) == len(up)


# --- expressions


def test_segmentation_prefers_fewest_then_longest():
    forms = {("a", "b"), ("b", "c", "d"), ("c", "d")}
    assert expressions.segment(list("abcd"), forms, 3) == ["a", "b c d"]
    assert expressions.segment([], forms, 3) == []


def test_expressions_found(spark):
    rnd = random.Random(1)
    fill = ["mesa", "silla", "luz", "agua", "tierra", "cielo", "fuego", "viento"]
    rows = [(i, 1, f"{rnd.choice(fill)} {rnd.choice(fill)} cambio climático global {rnd.choice(fill)}. {rnd.choice(fill)} {rnd.choice(fill)}, ley de aguas {rnd.choice(fill)} {rnd.choice(fill)}") for i in range(60)]
    c = spark.createDataFrame(rows, "id long, dm_speech int, speech string")
    got = {r.form: r for r in expressions.detect(c, least=20).collect()}
    assert "cambio climatico global" in got and "ley de aguas" in got and "cambio climatico" not in got
    assert got["cambio climatico global"].freq == 60
    table = spark.createDataFrame([("ley de aguas",)], "form string")
    assert expressions.occurrences(c, table).first().n == 60
    listed = expressions.listing(expressions.detect(c, least=20), table, order="g2").collect()
    assert "ley de aguas" not in {r.form for r in listed}


def test_expressions_counted_in_passes(spark):
    """All candidates in several passes as by an explode of each, from fewer shuffled rows."""
    rnd = random.Random(3)
    words = ["mesa", "luz", "agua", "ley", "cambio", "de", "la", "del", "x1", "10"]
    rows = [(i // 2, 1, ". ".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(12))) for _ in range(4))) for i in range(120)]
    spans = expressions.typed_spans(spark.createDataFrame(rows, "id long, dm_speech int, speech string")).cache()
    found = expressions.grams(spans).collect()
    f, docs, sides = Counter(r.gram for r in found), Counter(g for g, _ in {(r.gram, r.id) for r in found}), Counter()
    for r in found:
        sides.update((r.gram, side, w) for side, w in (("l", r.left), ("r", r.right)) if w)
    most = {}
    for (g, _, _), n in sides.items():
        most[g] = max(n, most.get(g, 0))
    for places in (50, 10**6):
        got = expressions.counts(spans, 3, beside=True, places=places).collect()
        assert {r.gram: (r.f, r.docs, r.most) for r in got} == {g: (n, docs[g], most.get(g)) for g, n in f.items() if n >= 3} and len(got) > 50
        assert {r.gram: (r.f, r.docs) for r in expressions.counts(spans, 3, places=places).collect()} == {g: (n, docs[g]) for g, n in f.items() if n >= 3}
    assert expressions.windows(spans).count() < 0.6 * len(found)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_expressions_by_shards(spark):
    """Small shards and many buckets, marks, wide gaps and final sigmas as by the plain spans; places over rare pairs aren't sent."""
    rnd = random.Random(5)
    words = ["mesa", "luz", "Ágúa", "a\u0301rea", "ΛΌΓΟΣ", "İstanbul", "cambio", "de", "la", "\u0301", "x1", "10", "under", "ley"]
    made = lambda k: rnd.choice([" ", ", ", "      ", " \u0301 "]).join(" ".join([*rnd.choices(words, k=rnd.randrange(9)), f"rara{k}", rnd.choice(words)]) for _ in range(4))
    c = spark.createDataFrame([(i // 2, int(i % 7 > 0), None if i % 31 == 0 else made(i)) for i in range(200)] + [(900, 1, "")], "id long, dm_speech int, speech string")
    found = expressions.candidates(c).collect()
    f, docs = Counter(r.gram for r in found), Counter(g for g, _ in {(r.gram, r.id) for r in found})
    want = {g: (n, docs[g]) for g, n in f.items() if n >= 4}
    assert {r.gram: (r.f, r.docs) for r in expressions.frequent(c, 4).collect()} == want and max(g.count(" ") for g in want) > 1
    rows = c.filter("dm_speech = 1").select("id", text.tokens_and_cuts(F.col("speech")).alias("s"))
    for positions, places in ((30, 20), (10**6, 10**6)):
        held = phrases.shards(rows, positions)
        vocabulary, salt = phrases.vocabulary(held)
        got = phrases.named(phrases.count(held, salt, 4, places=places).select("gram", "f", "docs"), vocabulary).collect()
        assert {r.gram: (r.f, r.docs) for r in got} == want
        assert (held.count() > 20) == (positions == 30)
    assert {r.token: r.fp for r in vocabulary.collect()} == Counter(t for r in expressions.typed_spans(c).collect() for t in r.s)
    assert expressions.frequent(c.limit(0), 4).count() == 0 and expressions.detect(c.limit(0), least=4).count() == 0
    # of a rare word's pairs none is frequent, so its places stay at home
    h, t, on = (np.array(x) for x in ([1, 2, 3, 9, 1, 2, 0], [2, 2, 2, 2, 2, 1, 0], [1, 1, 0, 0, 1, 0, 0]))
    at, reach = phrases._places(h, t, on.astype(bool), 7)
    assert at.tolist() == [0, 1] and reach.tolist() == [3, 2]


def test_saved_expressions(spark, tmp_path):
    table = spark.createDataFrame([("ley de aguas", 3)], "form string, freq int")
    expressions.save(table, str(tmp_path / "e"), "abc")
    assert expressions.load(spark, str(tmp_path / "e"), "abc").collect() == table.collect() and expressions.load(spark, str(tmp_path / "e"), "abd") is None


# --- speakers, documents, replies, mentions


@pytest.mark.parametrize(
    ("label", "role"),
    [
        ("SUMARIO", "summary"), ("COMENTARIOS", "remark"), ("El señor PRESIDENTE DEL GOBIERNO", "head_of_government"), ("El Presidente de la República", "head_of_state"), ("El señor PRESIDENTE DE EDAD", "chair_age"),
        ("La señora MINISTRA DE HACIENDA", "minister"), ("Sr. SECRETARIO PRIMERO", "secretary"), ("El señor VICEPRESIDENTE", "vicechair"), ("La señora PRESIDENTA", "chair"), ("El señor PRESIDENTE:", "chair"), ("Sr. PRESIDNTE", "chair"), ("Sra. PAZ", "deputy"), (None, "deputy"),
    ],
)
def test_roles(spark, label, role):
    row = speakers.parse(spark.createDataFrame([(label,)], "speaker string")).first()
    assert row.role == role


def test_climate_counts(spark):
    rows = [(1, "Gracias. (Aplausos en la sala.) Sigo (Rumores. El señor presidente agita la campana) y (no es nada) (Risas)"), (2, None), (3, "")]
    got = {r.id: r for r in speakers.climate(spark.createDataFrame(rows, "id long, speech string")).collect()}
    assert (got[1].applause, got[1].conflict, got[1].order, got[1].neutral, got[1].total) == (1, 1, 1, 1, 4) and got[2].total == got[3].total == 0


def test_document_blocks():
    doc = "ORDEN DEL DÍA\n\nEl señor GÓMEZ: Buenos días a\n\ntodos los presentes.\n\n(Aplausos.)\n\n- uno\n- dos\n\nPág. 12\n\nFin del texto."
    got = document.parse(doc)
    assert [b["kind"] for b in got] == ["head", "turn", "stage", "list", "par"] and [b["number"] for b in got] == [None, 1, None, 2, 3]
    assert all(doc[b["start"] : b["end"]].strip() for b in got) and "presentes" in got[1]["text"]
    long = " ".join(f"Palabra {i} de la frase numero uno larga." for i in range(80))
    cut = document.parse(long)
    assert len(cut) > 2 and all(document.TAIL <= len(b["text"].split()) <= document.MOST + document.TAIL for b in cut) and cut[0]["start"] == 0 and cut[-1]["end"] == len(long)
    assert document.parse(None) == [] and document.parse("") == []


def test_speech_only(spark):
    rows = spark.createDataFrame([(1, "TÍTULO\n\nHola a todos.\n\n(Aplausos.)\n\nAdiós (Risas) amigos.")], "id long, speech string")
    assert document.speech_only(rows).first().speech.split() == ["Hola", "a", "todos.", "Adiós", "amigos."]
    assert document.plain_text(document.documents(rows)).first().text.startswith("§1 Hola")


def test_allusions():
    assert replies.allusions("El señor Gómez lo dijo. Gómez no.", "Gómez", None) == (1, 0, 0)
    assert replies.allusions("Ana Gómez Ruiz lo dijo", "Gómez Ruiz", None) == (1, 0, 0)
    assert replies.allusions("Sigo (el señor Gómez: ¡No!) y (aplausos a Gómez)", "Gómez", None) == (0, 0, 1)
    assert replies.allusions("El ministro de justicia vino", "Gómez", "ministro de justicia")[1] == 1 and replies.allusions(None, "x", "y") == (0, 0, 0)


def test_reply_scores(spark):
    long = "palabra " * 50
    rows = [(1, "2010-01-01", 1, 1, 1, "Gómez", "Sr. GÓMEZ", "A", 60, long), (2, "2010-01-01", 1, 2, 2, "Paz", "Sra. PAZ", "B", 60, "El señor Gómez se equivoca. " + long), (3, "2010-01-01", 1, 3, 3, "Luz", "El señor PRESIDENTE", "A", 60, long), (4, None, 2, 1, 1, "Gómez", "Sr. GÓMEZ", "A", 60, long)]
    c = spark.createDataFrame(rows, "id long, date string, num_session int, ord int, rep_id int, rep_name string, speaker string, party string, nwords int, speech string")
    assert [tuple(r) for r in replies.synchronic(c).orderBy("id").collect()] == [(1, 2, 82.0, 1), (2, 1, 82.0, 1)]


def test_replies_at_any_distance(spark):
    """Against all pairs of a session scored as the reference does: long, with runs of one speaker and late answers."""
    rnd = random.Random(4)
    names = ["Gómez", "Paz", "Luz", "Ruiz", "Vega", "Soto"]
    rows = []
    for i in range(60):
        p = 0 if 20 < i < 36 else rnd.randrange(6)
        text = "palabra " * 50
        if rnd.random() < 0.3:
            text += f"El señor {rnd.choice(names)} lo dijo. "
        if rnd.random() < 0.2:
            text += f"(El señor {rnd.choice(names)}: ¡No!)"
        rows.append((i, "2010-01-01", 1, i, p, names[p], f"Sr. {names[p].upper()}", "AABBC"[p] if p < 5 else None, 60 + i % 3, text))
    c = spark.createDataFrame(rows, "id long, date string, num_session int, ord int, rep_id int, rep_name string, speaker string, party string, nwords int, speech string")
    weight = {(i, p): replies._weight(*replies.allusions(rows[i][9], names[p], None)) for i in range(60) for p in range(6)}
    want = []
    for a in rows:
        others = [b for b in rows if b[4] != a[4]]
        found = []
        for b in others:
            k = sum(min(a[3], b[3]) < x[3] < max(a[3], b[3]) for x in others)
            party = 12 * (a[7] is not None and b[7] is not None and a[7] != b[7])
            found.append((-round(weight[a[0], b[4]] + weight[b[0], a[4]] + 30 * 0.6**k + party, 1), abs(a[3] - b[3]), -b[8], b[0]))
        want += [(a[0], x[3], -x[0], k + 1) for k, x in enumerate(sorted(found)[:10])]
    got = sorted((tuple(r) for r in replies.synchronic(c).collect()), key=lambda r: (r[0], r[3]))
    assert got == want
    assert any(abs(a - b) > 13 and s >= 40 for a, b, s, _ in got)


def test_mention_scan_and_resolution(spark):
    found = mentions.scan("Gracias, señor Gómez. La ministra Paz Ruiz vino a la calle general Prim. (El señor Luz: no) Tiene la palabra el señor Sol.")
    assert [(m["form"], m["office"], m["name"], m["vocative"]) for m in found] == [("senor", None, "Gómez", True), ("ministra", "ministra", "Paz Ruiz", False)]
    assert mentions.scan(None) == []
    rows = [(1, "2010-01-01", 1, 1, "Ana Gómez", "A", "El señor Gómez habló. El señor Desconocido Total también. El presidente salió."), (2, "2010-01-01", 1, 2, "Luis Paz", "B", "Hola. El diputado Luis Paz soy yo.")]
    c = spark.createDataFrame(rows, "id long, date string, num_session int, rep_id int, rep_name string, party string, speech string")
    holders = spark.createDataFrame([("presidente", "Zoe Rey", "2009-01-01", None)], "key string, name string, date_from string, date_to string")
    got = mentions.resolve(mentions.candidates(c), mentions.roster(c), holders)
    assert sorted(r.person for r in got.collect()) == ["1", "2", "ext:desconocido total", "ext:zoe rey"]
    assert {(r.a, r.b) for r in mentions.edges(got).collect()} == {("1", "ext:desconocido total"), ("1", "ext:zoe rey")}
    assert mentions.together(got).filter("a = '1'").count() == 2 and mentions.emitted(got).first().rep_id == 1
    back = spark.createDataFrame([("1", "2", 3), ("2", "1", 2), ("1", "3", 9)], "a string, b string, n long")
    assert [tuple(r) for r in mentions.dialogues(back).collect()] == [("1", "2", 3, 2)]
    assert mentions.rates(got, c.withColumn("nwords", F.lit(10))).count() == 2


# --- library, time, sessions, streams


def test_library_changes(spark):
    collections = spark.createDataFrame([(1, "a", "", "")], "id int, name string, description string, color string")
    more = library.create(collections, "b")
    assert [(r.id, r.name) for r in more.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    for name in ("", "a"):
        with pytest.raises(ValueError, match="collection"):
            library.create(collections, name)
    items = spark.createDataFrame([(1, "ES", 5, "n", ["t"], 4)], "collection_id int, corpus string, id long, note string, tags array<string>, position int")
    ids = spark.createDataFrame([(5, 0), (6, 1), (6, 2), (7, 3)], "id long, k int")
    grown = library.add_items(items, 1, "ES", ids)
    assert sorted((r.id, r.position) for r in grown.collect()) == [(5, 4), (6, 6), (7, 8)]
    assert library.annotate(grown, 1, 6, "hey", ["x"]).filter("id = 6").first().tags == ["x"]
    assert library.notes_summary(grown, 1, 2).count() == 2
    assert library.delete(more, grown, 1)[1].count() == 0 and library.update(more, 2, name="c").filter("id = 2").first().name == "c"
    assert {(r.old_id, r.new_id) for r in library.restore(more, more).collect()} == {(1, 3), (2, 4)}


def test_as_of(spark):
    rows = spark.createDataFrame([(1, "x", "2009"), (2, "x", "2012"), (3, "x", None), (4, "z", "2012")], "id int, k string, at string")
    options = spark.createDataFrame([("x", "2010", "old"), ("x", "2012", "new")], "k string, valid_from string, v string")
    assert {r.id: r.v for r in temporal.as_of(rows, "k", "at", options, "v").collect()} == {1: "old", 2: "new", 3: "old", 4: None}


def test_session_texts(spark):
    c = corpus(spark, D)
    date = c.filter("num_session = 3").first().date
    assert [r.ord for r in sessions.texts(c, date, 3, 2).orderBy("ord").collect()] == list(range(2, 8))
    assert sessions.texts(c, date, 3, 0, 60, 1).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{D}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = streams.new_files(spark, str(tmp_path / "in"), table.schema).select("event_id", "ts", "event_type", "value")
    streams.run_available(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, streams.windowed(back).collect())) == sorted(map(tuple, streams.windowed(table).collect()))
    query = streams.windowed(streams.new_files(spark, str(tmp_path / "in"), table.schema), late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    query.awaitTermination()
    as_text = lambda df: sorted(map(tuple, df.withColumn("start", F.col("start").cast("string")).collect()))
    assert as_text(spark.table("w")) == as_text(streams.windowed(table))


# --- views


def test_views(spark):
    assert views.theme_query(["casa", "de la", "casa"]) == 'casa | "de la"' and parse(views.theme_query(["casa", "de la"])).text() == 'casa | "de la"'
    assert views.theme_ranges("El Cambio Climático y el cambio", ["cambio", "cambio climatico"]) == [(3, 19, "cambio climatico"), (25, 31, "cambio")]
    assert views.seed_terms(parse('casa "de la"').terms()) == ["casa", '"de la"']
    rows = spark.createDataFrame([("2020-02-29",), ("20200229",), ("2020-W53-5",), ("2021-W53-1",), ("2020-13-01",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in rows.select(views.iso_date(F.col("d"))).collect()] == ["2020-02-29", "2020-02-29", "2021-01-01", "None", "None", "None", "None"]
    with pytest.raises(ValueError, match="direction"):
        views.ego(rows, "a", "up")


def test_numbers_are_dense(spark):
    from lexistrata.functions.ranking import numbered

    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k int").repartition(5)
    got = numbered(rows, ["k"], "n", 1).collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 1) for i in range(101)]
    assert numbered(rows.filter("k < 0"), ["k"], "n").count() == 0
