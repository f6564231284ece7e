"""Running heads of planted pages, and the labelling against all sequences."""

import itertools
import random
from collections import Counter

from lexistrata.operators import pages


def test_planted_heads_are_found_and_left_out(spark):
    rng = random.Random(3)
    rows, want = [], Counter()
    i = 0
    for s in range(3):
        for page in range(1, 9):
            head = f"CONGRESO, 3 DE MAYO DE 19{s}9 — NÚM. {page}" if s < 2 else "Página sin número"
            body = [" ".join(rng.choice("abcdef") for _ in range(12)) + "." for _ in range(4)] + ["¡Muy bien!"] * (page == 1)
            rows.append((i, s, "\n".join([head, *body, f"— {page} —"] if s == 0 else [head, *body])))
            i += 1
    rows.append((i, 2, None))
    c = spark.createDataFrame(rows, "id long, num_session int, speech string")
    heads = pages.running_heads(c)
    want = {(0, "congreso, # de mayo de # — num. #", 8), (0, "— # —", 8), (1, "congreso, # de mayo de # — num. #", 8), (2, "pagina sin numero", 8)}
    assert {tuple(r) for r in heads.collect()} == want
    left = pages.without_heads(c, heads).orderBy("id").collect()
    assert [r.id for r in left] == [r[0] for r in rows] and left[-1].speech is None
    assert all("CONGRESO" not in (r.speech or "") and "Página" not in (r.speech or "") and "— 1 —" not in (r.speech or "") for r in left)
    assert left[0].speech.endswith("¡Muy bien!") and left[0].speech.count("\n") == 4


SAMPLES = ["ORDEN DEL DÍA", "Un párrafo corriente con bastantes palabras para serlo, y otra frase.", "- uno", "dos sin raya", "(Aplausos.)", "El señor GÓMEZ: Buenos días a todos.", "a  |  b\n1  |  2", "total  12", "Nota: aparte.", "x", "", "TOTAL GENERAL"]


def test_labels_are_the_best_sequence():
    rng = random.Random(1)
    for _ in range(40):
        texts = [rng.choice(SAMPLES) for _ in range(rng.randrange(1, 6))]
        own = [pages.scores(t) for t in texts]

        def worth(seq, own=own):
            return sum(s[pages.KINDS.index(k)] for s, k in zip(own, seq, strict=True)) + sum(pages.FOLLOWS.get(p, 0.0) for p in itertools.pairwise(seq))

        best = max(worth(seq) for seq in itertools.product(pages.KINDS, repeat=len(texts)))
        assert abs(worth(pages.label(texts)) - best) < 1e-9
    assert pages.label([]) == []


def test_neighbours_decide(spark):
    texts = ["ORDEN DEL DÍA", "- uno", "dos sin raya", "- tres", "(Aplausos.)", "El señor GÓMEZ: Buenos días a todos.", "Un párrafo corriente con bastantes palabras para serlo, y otra frase más."]
    assert pages.label(texts) == ["head", "list", "list", "list", "stage", "turn", "par"]
    assert pages.label(["dos sin raya"]) == ["par"]
    c = spark.createDataFrame([(1, "\n\n".join(texts)), (2, None), (3, "")], "id long, speech string")
    got = pages.labels(c).orderBy("id", "k").collect()
    assert [r.kind for r in got] == pages.label(texts) and [texts[r.k] for r in got] == ["\n\n".join(texts)[r.start : r.end] for r in got]
