"""Mentions, who is meant, and turns of the chair, against plain versions over planted speeches."""

import random
import re
from collections import Counter, defaultdict
from statistics import median_high

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexistrata import registry
from lexistrata.functions.ranking import cut
from lexistrata.operators import chair, mentions, persons
from lexistrata.registry import GIVEN as GIVEN_TEXTS

GIVEN = ["Ana", "Luis", "Pedro", "Inés", "Marta"]
SURNAMES = ["Gómez", "Vidarte", "Calixto", "Beltrán", "Osorio", "Zabala"]
FORMS = "id long, date string, num_session int, ord int, legislature string, rep_id int, rep_name string, party string, speaker string, nwords int, speech string"


def planted(rng, sessions=12, turns=14):
    rows, i = [], 0
    for s in range(sessions):
        for o in range(turns if s else 60):
            parts = []
            for _ in range(rng.randrange(6)):
                g, x, y = rng.choice(GIVEN), rng.choice(SURNAMES), rng.choice(SURNAMES)
                parts.append(
                    rng.choice(
                        [f"El señor {g} {x} habló.", f"Dijo {x} que no.", f"{x} lo sabe.", f"la diputada {g} {x} {y} vino;", f"Los señores {g} {x}, {x} y {g} {y} salieron.", f"La familia {x} no.", f"Ayer {g} {x} calló.",
                         f"con {x} {y} fuimos", f"el ministro de Hacienda, {g} {x}, y {y}.", f"(Rumores de {x}.)", f"el vidarte y la mesa {x.lower()[:3]}", f"calle {x}", f"y el señor {x}:"]
                    )
                )
            rep = rng.randrange(8)
            rows.append((i, f"20{10 + s:02d}-01-01", s, o, "I" if s < 6 else "II", rep, f"{GIVEN[rep % 5]} {SURNAMES[rep % 6]}", "A", "Sr. X", 9, " ".join(parts)))
            i += 1
    return rows


# --- scan


def test_lists_institutions_and_initials():
    got = mentions.scan("Los señores Gómez, Paz Ruiz y De la Vega votaron con las diputadas Ana María Soto, Luz e Inés Prado, y Sol. El ministro de Hacienda y el Sr. J. Pérez.\nEl presidente del Consejo de Ministros, Pedro Sol Luna, vino.")
    assert [(m["form"], m["office"], m["institution"], m["name"]) for m in got] == [
        ("senor", None, None, "Gómez"), ("senor", None, None, "Paz Ruiz"), ("senor", None, None, "De la Vega"), ("diputada", None, None, "Ana María Soto"), ("diputada", None, None, "Luz"), ("diputada", None, None, "Inés Prado"),
        ("ministro", "ministro", "Hacienda", None), ("sr", None, None, "J. Pérez"), ("presidente", "presidente", "Consejo de Ministros", "Pedro Sol Luna"),
    ]
    assert mentions.scan("los diputados Gómez\ny Paz")[0]["name"] == "Gómez" and len(mentions.scan("los diputados Gómez\ny Paz")) == 1
    assert mentions.scan("el ministro de la paz") == [{"at": 3, "form": "ministro", "office": "ministro", "institution": None, "name": None, "vocative": False, "end": 11}]


def test_a_form_is_no_name():
    assert mentions.scan("The The The The The ontion", GIVEN_TEXTS) == [] == mentions.scan("los les les les les Les", GIVEN_TEXTS)
    assert [m["name"] for m in mentions.scan("The The The The The License", GIVEN_TEXTS)] == ["The License"]
    assert mentions.scan("Señor Don Doctor Diputado Doctora habló.") == []


def test_rows_of_forms_and_headings_match_sql(spark, tmp_path):
    """The mention queries over texts in which forms stand in a row and lines are long, against their SQL."""
    texts = [("The " * n + tail).replace("The ", "The" + mark) for n in range(1, 12) for tail in ("ontion", "MIT License", "And And", "License. Les Apache", "", "\nApache") for mark in (" ", ". ")]
    # a heading is judged by its whole line, however long
    texts += ["AB CD " * 2000 + "this is of the Apache. And so on with the ordinary small letters of a text. " * 8 + "AB CD " * 2000, "AB CD " * 90 + "small letters all the Way. " * 900 + "the MIT AND SO ON"]
    texts += ["under the MIT License. " * 3, "MIT License les les Les LES Les", None]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("mention_found", "mention_edges", "mention_contexts", "mention_rates", "mention_ego"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want, name


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["señor", "los", "señores", "Gómez", "De", "la", "de", "y", "e", ",", ".", "\n", "ministro", "(", ")", "J.", "Ruiz", "Sr."]), max_size=25))
def test_spans_lie_in_order_without_overlap(words):
    text = " ".join(words)
    got = mentions.scan(text)
    for a, b in zip(got, got[1:], strict=False):
        assert a["at"] < a["end"] <= b["at"]
    assert all(m["name"] is None or m["name"] in text[m["at"] : m["end"]] for m in got)
    taken = [(m["at"], m["end"]) for m in got]
    assert all(not (a < m["at"] < b) for m in mentions.scanner(mentions.DEFAULT).loose(text) for a, b in taken)


def test_long_texts_take_linear_time():
    assert len(mentions.scan("el señor Gómez " * 20_000)) == 20_000
    assert len(mentions.scan("los señores Gómez, " + "Paz, " * 20_000)) == 20_001
    assert len(mentions.scanner(mentions.DEFAULT).loose("hay Gómez aquí " * 20_000)) == 20_000


# --- who is meant


def test_evidence_matches_plain(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        leg, speaker = rng.choice(["I", "II", "III"]), rng.randrange(6)
        if rng.random() < 0.6:
            rows.append((i, 1, leg, speaker, str(rng.choice([1, 1, 1, 1, 1, 1, 1, 2, 3])) if leg != "III" else "ext:x", None))
        else:
            rows.append((i, 1, leg, speaker, None, [str(x) for x in rng.sample([1, 2, 3, 4, 9], rng.randint(2, 3))] if rng.random() < 0.9 else None))
    got = persons.by_evidence(spark.createDataFrame(rows, "id long, at int, legislature string, rep_id int, person string, options array<string>"))
    within, overall = Counter((r[2], r[4]) for r in rows if r[4]), Counter(r[4] for r in rows if r[4])
    want = {}
    for i, _, leg, speaker, person, options in rows:
        if person is None and options:
            counts = {o: within[leg, o] for o in options}
            if not any(counts.values()):
                counts = {o: overall[o] for o in options}
            (o, n), (_, m) = sorted(counts.items(), key=lambda x: -x[1])[:2]
            person = o if n >= 5 and n >= 5 * max(1, m) and o != str(speaker) else None
        want[i] = person
    assert {r.id: r.person for r in got.collect()} == want and sum(r[4] is None and want[r[0]] is not None for r in rows) > 50
    assert all((r.person is None) or r.options is None for r in got.collect())


def plain_names(counts, given, common, times=3):
    words = {k: k.split() for k in counts}
    several = [k for k in counts if len(words[k]) > 1]
    begun = {k: max(((len(words[x]), counts[x], x) for x in several if len(words[x]) > len(words[k]) and words[x][: len(words[k])] == words[k]), default=(0, 0, None))[2] for k in several}
    up = {}
    for k in several:
        ended = [x for x in several if len(words[x]) > len(words[k]) and words[x][-len(words[k]) :] == words[k] and not begun[x]]
        up[k] = begun[k] or (ended[0] if len(ended) == 1 and words[k][0] not in given else k)
    root = {}
    for k in several:
        r = k
        while up[r] != r:
            r = up[r]
        root[k] = r
    weight = Counter()
    for k, r in root.items():
        weight[r] += counts[k]
    tail = {k: next((w for w in words[k][1:] if w not in given), words[k][-1]) for k in several}
    for k in counts:
        if k not in root:
            to = sorted({root[x] for x in several if tail[x] == k}, key=lambda r: (-weight[r], r))
            clear = to and (len(to) == 1 or weight[to[0]] >= times * weight[to[1]]) and k not in common
            root[k] = to[0] if clear else k
    return root


def test_outsiders_match_plain(spark):
    rng = random.Random(6)
    given, words = ["jose", "maria"], ["jose", "maria", "aznar", "lopez", "sol", "vega", "ruiz", "perez", "paz"]
    rows = []
    for i in range(700):
        name = " ".join(rng.sample(words, rng.choice([1, 1, 2, 2, 3, 4, 5])))
        rows.append((i, 1, i % 40, "12" if i % 19 == 0 else None if i % 23 == 0 else "ext:" + name))
    table = spark.createDataFrame(rows, "id long, at int, num_session int, person string")
    known = spark.createDataFrame([(w,) for w in given], "word string")
    counts = Counter(r[3][4:] for r in rows if r[3] and r[3].startswith("ext:"))
    want = plain_names(counts, given, mentions.DEFAULT.common)
    got = {r.key: r.root for r in persons.outsider_names(table, known).collect()}
    assert got == want and sum(k != r for k, r in want.items()) > 20
    # a single word that stays alone is the only person of the session who has it
    first = {r[0]: "ext:" + want[r[3][4:]] if r[3] and r[3].startswith("ext:") else r[3] for r in rows}
    there = defaultdict(set)
    for i, _, s, _ in rows:
        if first[i] and " " in first[i]:
            there[s].add(first[i])
    for i, _, s, _ in rows:
        p = first[i]
        if p and p.startswith("ext:") and " " not in p and p[4:] not in given:
            only = [x for x in there[s] if p[4:] in x[4:].split()[1:]]
            first[i] = only[0] if len(only) == 1 else p
    assert {r.id: r.person for r in persons.merge_outsiders(table, known).collect()} == first


def plain_loose(rows, sure, people, least):
    """Walks each session in order, keeping the person last named in full for each surname."""
    scanner = mentions.scanner(mentions.DEFAULT)
    fold = mentions._plain
    named = defaultdict(list)
    for m in sure:
        if m["person"] and m["name"]:
            parts = [w for w in re.findall(r"[^\W_]+", fold(m["name"])) if len(w) > 2]
            if len(parts) > 1:
                theirs = people.get(m["person"]) or m["person"].removeprefix("ext:").split()
                named[m["id"]].append((m["at"], parts, m["person"], set(parts) | set(theirs)))
    uses = Counter(w for ms in named.values() for _, parts, _, _ in ms for w in dict.fromkeys(x for x in parts[1:] if len(x) > 3))
    large, small = Counter(), Counter()
    for r in rows:
        for t in re.findall(r"[^\W\d_]{4,}", r[-1]):
            (large if t[0] != t[0].lower() else small)[fold(t)] += 1
    known = {w for w, n in uses.items() if n >= least and large[w] >= 2 and small[w] <= max(1, 0.05 * (large[w] + small[w])) and w not in mentions.DEFAULT.common}
    out, last = set(), defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        events = [(at, 1, (parts, person, words)) for at, parts, person, words in named[r[0]]] + [(m["at"], 0, m) for m in scanner.loose(r[-1])]
        for at, full, e in sorted(events, key=lambda x: x[:2]):
            if full:
                for w in e[0][1:]:
                    if len(w) > 3 and w in known:
                        last[r[2]][w] = e[1:]
            elif e["word"] in last[r[2]]:
                person, words = last[r[2]][e["word"]]
                ordered = theirs_in_order(people, person, words, named)
                if all(e[c] is None or e[c] in words for c in ("before", "after")) and not (e["before"] in ordered) and person != str(r[5]):
                    out.add((r[0], at, person))
    return out


def theirs_in_order(people, person, words, named):
    """Words after the first of the name as it is known: those of the mention, then those of the person."""
    for ms in named.values():
        for _, parts, p, all_ in ms:
            if p == person and all_ == words:
                return set(list(dict.fromkeys(parts + (people.get(p) or p.removeprefix("ext:").split())))[1:])
    return set()


@pytest.mark.parametrize("seed", [1, 2])
def test_loose_surnames_match_plain(spark, seed):
    rows = planted(random.Random(seed))
    c = spark.createDataFrame(rows, FORMS).repartition(5)
    people = cut(mentions.roster(c))
    found = cut(persons.by_evidence(cut(mentions.resolve(mentions.candidates(c), people))))
    sure = cut(persons.merge_outsiders(found, persons.given_names(people)))
    got = persons.loose_surnames(c, sure, mentions.capitals(c), people, least=3)
    want = plain_loose(rows, [r.asDict() for r in sure.collect()], {str(r.rep_id): list(r.words) for r in people.collect()}, 3)
    assert {(r.id, r["at"], r.person) for r in got.collect()} == want and len(want) > 30
    every = persons.all_mentions(c)
    assert every.filter("loose").count() == len(want) and every.filter("NOT loose").count() == sure.count()


def test_party_words_without_the_chair(spark):
    labels = ["La señora PRESIDENTA", "El señor VICEPRESIDENTE", "El Presidente de edad", "Sra. PAZ", "Sr. MINISTRO DE HACIENDA", None]
    rows = [(p, label, 10**k) for p in ("A", "B") for k, label in enumerate(labels)]
    got = mentions.party_words(spark.createDataFrame(rows, "party string, speaker string, nwords int")).collect()
    assert sorted(map(tuple, got)) == [("A", 111_000), ("B", 111_000)]


def test_mentions_of_nothing(spark):
    c = spark.createDataFrame([(1, None, 1, 1, None, None, None, None, None, 0, None), (2, "2010-01-01", 1, 2, "I", 1, "Ana Paz", "A", "x", 0, "")], FORMS)
    assert persons.all_mentions(c).collect() == [] and persons.all_mentions(c.filter("id < 0")).collect() == []
    assert chair.chair_turns(c.filter("id < 0")).collect() == []


# --- the chair


def test_winnowing_guarantee():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(2000)]
    for _ in range(30):
        shared = " ".join(rng.choice(words) for _ in range(8 + 16 - 1))
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randrange(40))) + " " + shared + " " + " ".join(rng.choice(words) for _ in range(30)) for _ in range(2))
        assert {h for h, _ in chair.fingerprints(a, 8, 16)} & {h for h, _ in chair.fingerprints(b, 8, 16)}
    plain = []
    text = " ".join(rng.choice("abc") for _ in range(300))
    hashes = [chair.fingerprints(" ".join(text.split()[i : i + 4]), 4, 1)[0][0] for i in range(297)]
    for i in range(297 - 9):
        low = min(hashes[i : i + 10])
        plain.append(max(k for k in range(i, i + 10) if hashes[k] == low))
    assert [a for _, a in chair.fingerprints(text, 4, 10)] == sorted(set(plain))
    assert chair.fingerprints(None, 8, 16) == chair.fingerprints("a b", 8, 16) == []


def test_repeated_turns(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    one, two = fresh(120), fresh(120)
    rows = [(1, 1, 1, one), (2, 1, 2, fresh(120)), (3, 1, 3, one), (4, 1, 4, one[: len(one) // 4] + " " + fresh(100)), (5, 2, 1, one), (6, 2, 2, two), (7, 2, 3, two + " " + fresh(8)), (8, 2, 4, None), (9, 1, 0, "kurz " * 20)]
    got = chair.repeated(spark.createDataFrame(rows, "id long, num_session int, ord int, speech string"))
    assert {r.id for r in got.collect()} == {3, 7}


def plain_shares(turns, least):
    out = set()
    for s in {t[0] for t in turns}:
        by = defaultdict(list)
        for _, who, size in (t for t in turns if t[0] == s and t[1] is not None):
            by[who].append(size)
        n = sum(map(len, by.values()))
        order = sorted(by, key=lambda w: (-len(by[w]), w))
        if not order or len(by[order[0]]) < max(least, 0.25 * n) or (median_high(by[order[0]]) > 400 and len(by[order[0]]) < 0.35 * n):
            continue
        out.add((s, order[0], "share"))
        out |= {(s, w, "clerk") for w in order[1:] if len(by[w]) >= max(least, 0.15 * n) and median_high(by[w]) <= 250}
    return out


def test_shares_match_plain(spark):
    rng = random.Random(8)
    turns = [(s, rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, None]) if s % 2 else rng.randrange(4 + s), rng.choice([50, 100, 300, 450, 900]) // (1 + s % 3)) for s in range(40) for _ in range(rng.randrange(1, 40))]
    got = chair.shares(spark.createDataFrame(turns, "num_session int, rep_id int, size int"))
    want = plain_shares(turns, 5)
    assert {tuple(r) for r in got.collect()} == want and {w for _, _, w in want} == {"share", "clerk"}


def test_chair_turns(spark):
    long = " ".join(f"palabra{k}" for k in range(100))
    rows, i = [], 0

    def turn(session, rep, speaker, speech):
        nonlocal i
        rows.append((i, "2010-01-01", session, i, "I", rep, f"R{rep}", "A", speaker, 9, speech))
        i += 1
        return i - 1

    want = {turn(1, None, "El señor PRESIDENTE", "Buenos días."): ["label"], turn(1, 2, "Sra. PAZ", "Se abre la sesión. " + long): ["opening"]}
    want[turn(1, None, "Sr. SOL", long)] = ["repeated"]
    turn(1, 4, "Sr. GÓMEZ", "Nada.")
    for k in range(6):  # no label: most turns, short
        want[turn(2, 7, "R7", f"Gracias {k}.")] = ["share"]
        turn(2, 10 + k, "x", f"{k} otra cosa " + " ".join(f"{k}v{j}" for j in range(90)))
    for k in range(3):
        want[turn(3, 1, "R1", f"El señor {k} tiene la palabra.")] = ["formula"]
        for j in range(4):
            turn(3, 20 + 4 * k + j, "y", "Sí.")
    want[turn(4, 5, "La señora PRESIDENTA", "Hola.")] = ["label"]
    for k in range(2):
        want[turn(4, 5, "PÉREZ", f"Adelante {k}.")] = ["name"]
    turn(4, 5, "Diputada PÉREZ", "Hablo desde el escaño.")
    got = chair.chair_turns(spark.createDataFrame(rows, FORMS))
    assert {r.id: list(r.why) for r in got.collect()} == want
    assert chair.floor_turns(spark.createDataFrame(rows, FORMS)).count() == len(rows) - len(want)
