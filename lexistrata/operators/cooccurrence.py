"""Co-occurrence network of a collection's vocabulary, its themes, parties and reading list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import cut
from ..functions.stats import log_likelihood
from ..functions.text import index_tokens
from .expressions import NUMBERS
from .graph import leiden
from .keyness import keyness


def vocabulary(lexicon: DataFrame, size: int = 250, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(term, g2): the most over-used terms of a lexicon, without numbers and excluded ones."""
    good = lexicon.filter((F.col("g2") > 0) & (F.char_length("term") >= 2) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*NUMBERS, *excluded))
    return good.orderBy(F.bround("g2", 2).desc(), "term").limit(size).select("term", "g2")


def unit_terms(corpus: DataFrame, terms: DataFrame, fragment: int | None = None, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, terms) with the sorted vocabulary of each unit, and (n): all units, empty ones too.

    A unit is a speech, or with ``fragment`` a run of so many tokens. The
    vocabulary has a bounded size and is broadcast. ``tokens`` is an array column
    to read instead of the speech's tokens, such as its expressions.
    """
    rows = corpus.select("id", F.posexplode(index_tokens(F.col("speech")) if tokens is None else tokens).alias("pos", "term"))
    part = F.lit(0) if fragment is None else F.floor(F.col("pos") / fragment)
    rows = rows.select(F.struct("id", part.alias("part")).alias("unit"), "term")
    n = rows.agg(F.countDistinct("unit").alias("n")) if fragment else corpus.agg(F.count("*").alias("n"))
    kept = rows.join(F.broadcast(terms.select("term")), "term").groupBy("unit").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return kept, n


def edges(corpus: DataFrame, terms: DataFrame, fragment: int | None = None, g2_min: float = 10.83) -> DataFrame:
    """(a, b, n, weight, g2): pairs that co-occur more than chance has it, a < b.

    Pairs are formed inside the sorted array of a unit, which holds at most the
    vocabulary, so counting needs one shuffle with partial aggregation.
    """
    units, n = unit_terms(corpus, terms, fragment)
    units = cut(units)  # read twice, and made from the texts
    df = units.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    pairs = units.select(F.posexplode("terms").alias("i", "a"), "terms").select("a", F.explode(F.slice("terms", F.col("i") + 2, F.greatest(F.lit(0), F.size("terms") - F.col("i") - 1))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("both"))
    full = counts.join(F.broadcast(df.select(F.col("term").alias("a"), F.col("df").alias("da"))), "a").join(F.broadcast(df.select(F.col("term").alias("b"), F.col("df").alias("db"))), "b").crossJoin(F.broadcast(n))
    expected = F.col("da") * F.col("db") / F.col("n")
    full = full.withColumn("weight", F.col("both") / expected).filter(F.col("both") > expected)
    g2 = log_likelihood(F.col("both"), F.col("db") - F.col("both"), F.col("da"), F.col("n") - F.col("da"))
    return full.withColumn("g2", g2).filter(F.col("g2") >= g2_min).select("a", "b", F.col("both").alias("n"), "weight", "g2")


def nearest(network: DataFrame, k: int = 10) -> DataFrame:
    """Edges among the k strongest of either end."""
    doubled = network.select("a", "b", "g2", F.col("a").alias("node"), F.col("b").alias("other")).unionAll(network.select("a", "b", "g2", F.col("b").alias("node"), F.col("a").alias("other")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.bround("g2", 6).desc(), "other"))
    kept = doubled.withColumn("r", rank).filter(F.col("r") <= k).select("a", "b").distinct()
    return network.join(kept, ["a", "b"], "left_semi")


def themes(network: DataFrame, terms: DataFrame, gamma: float = 1.0, seed: int = 1, least: int = 3) -> DataFrame:
    """(theme, term, strength, g2, label): communities of at least ``least`` terms; theme -1 holds loose terms.

    The network has at most the vocabulary's nodes, so it is solved on the driver.
    """
    spark = network.sparkSession
    g2 = {r.term: r.g2 for r in terms.orderBy("term").collect()}
    names = list(g2)
    at = {t: i for i, t in enumerate(names)}
    links = [(at[r.a], at[r.b], r.weight) for r in network.orderBy("a", "b").collect()]
    part, _ = leiden(len(names), links, gamma, seed)
    strength = [0.0] * len(names)
    for a, b, w in links:
        if part[a] == part[b]:
            strength[a] += w
            strength[b] += w
    groups: dict[int, list[int]] = {}
    for i, c in enumerate(part):
        groups.setdefault(c, []).append(i)
    real = sorted((c for c in groups if len(groups[c]) >= least), key=lambda c: (-sum(g2[names[i]] for i in groups[c]) / len(groups[c]), c))
    order = {c: k for k, c in enumerate(real)}
    rows = []
    for c, members in groups.items():
        members.sort(key=lambda i: (-strength[i], -g2[names[i]], i))
        label = " · ".join(names[i] for i in members[:3]) if c in order else None
        rows += [(order.get(c, -1), names[i], strength[i], g2[names[i]], label) for i in members]
    return spark.createDataFrame(rows, "theme int, term string, strength double, g2 double, label string")


def reading(corpus: DataFrame, weights: DataFrame, top: int = 25) -> DataFrame:
    """(theme, id, score, k): best speeches of each theme by BM25 with weights ln(1 + G2)."""
    rows = corpus.select("id", index_tokens(F.col("speech")).alias("tokens")).withColumn("dl", F.size("tokens"))
    mean = rows.agg(F.avg("dl").alias("avg"))
    tf = rows.select("id", "dl", F.explode("tokens").alias("term")).join(weights.select("theme", "term", "g2"), "term").groupBy("theme", "id", "dl", "term", "g2").agg(F.count("*").alias("tf"))
    tf = tf.crossJoin(F.broadcast(mean))
    part = F.log1p("g2") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avg")))
    score = tf.groupBy("theme", "id").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("theme").orderBy(F.round("score", 6).desc(), "id"))
    return score.withColumn("k", rank).filter(F.col("k") <= top)


def varied(lists: DataFrame, most: int = 100) -> list[int]:
    """Ids dealt round from the themes' reading lists, none twice. The lists hold at most themes * 25 rows."""
    queues: dict[int, list[int]] = {}
    for r in lists.orderBy("theme", "k").collect():
        queues.setdefault(r.theme, []).append(r.id)
    out: dict[int, None] = {}
    while len(out) < most and any(queues.values()):
        for q in queues.values():
            while q and q[0] in out:
                q.pop(0)
            if q and len(out) < most:
                out[q.pop(0)] = None
    return list(out)


def party_rates(corpus: DataFrame, terms: DataFrame, collection: DataFrame | None = None) -> DataFrame:
    """(party, hits, words, per_thousand, expected, ratio, shown) of a term list by party.

    ``shown`` asks for one percent of the words and five expected hits.
    """
    rows = corpus if collection is None else corpus.join(collection.select("id"), "id", "left_semi")
    rows = rows.filter(F.col("party").isNotNull() & ~F.col("party").isin("", "?", "Sin identificar"))
    tokens = rows.select("party", F.explode(index_tokens(F.col("speech"))).alias("term"))
    marked = tokens.join(terms.select("term").distinct().withColumn("one", F.lit(1)), "term", "left")
    by = marked.groupBy("party").agg(F.count("one").alias("hits"), F.count("*").alias("words"))
    whole = by.agg(F.sum("hits").alias("all_hits"), F.sum("words").alias("all_words"))
    expected = F.col("all_hits") * F.col("words") / F.col("all_words")
    out = by.crossJoin(F.broadcast(whole)).withColumn("expected", expected)
    half = F.when(F.col("hits") == 0, F.lit(0.5)).otherwise(F.col("hits"))
    return out.select("party", "hits", "words", (F.col("hits") / F.col("words") * 1000).alias("per_thousand"), "expected", (half / F.col("expected")).alias("ratio"), ((F.col("words") >= 0.01 * F.col("all_words")) & (F.col("expected") >= 5)).alias("shown"))


def dominant_theme(corpus: DataFrame, members: DataFrame) -> DataFrame:
    """(id, theme): the theme of which a speech uses the largest share of terms: at least two, and no tie."""
    tokens = corpus.select("id", F.explode(F.array_distinct(index_tokens(F.col("speech")))).alias("term")).join(members.select("theme", "term"), "term")
    size = members.groupBy("theme").agg(F.count("*").alias("size"))
    used = tokens.groupBy("id", "theme").agg(F.count("*").alias("n")).join(size, "theme").withColumn("share", F.col("n") / F.col("size"))
    top = used.withColumn("best", F.max("share").over(Window.partitionBy("id"))).filter("share = best")
    return top.groupBy("id").agg(F.count("*").alias("ties"), F.max("n").alias("n"), F.max("theme").alias("theme")).filter("ties = 1 AND n >= 2").select("id", "theme")


def network(corpus: DataFrame, collection: DataFrame, size: int = 250, fragment: int | None = None, k: int = 10, min_freq: int = 5, g2_min: float = 10.83) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, pruned edges) of a collection."""
    terms = cut(vocabulary(keyness(corpus, collection, min_freq), size))
    own = corpus.join(collection.select("id"), "id", "left_semi").filter("dm_speech = 1")
    return terms, nearest(edges(own, terms, fragment, g2_min), k)
