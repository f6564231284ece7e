"""Who is meant: evidence for unsure members, outsiders under several names, and bare surnames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import cut, written
from ..functions.text import fold
from .mentions import DEFAULT, Lexicon, name_words

_OUT = "ext:"


def by_evidence(mentions: DataFrame, least: int = 5, times: int = 5) -> DataFrame:
    """Gives unsure mentions to the member who is surely meant far more often.

    Counts are those of the mention's legislature, or of all where none of the
    options has any there; the first needs ``least`` of them and ``times`` as
    many as the next. ``options`` is null afterwards where ``person`` is not. A
    speaker isn't taken for the person that the own speech mentions.
    """
    sure = mentions.filter(F.col("person").isNotNull() & ~F.startswith("person", F.lit(_OUT)))
    within = sure.groupBy("legislature", F.col("person").alias("o")).agg(F.count("*").alias("within"))
    overall = sure.groupBy(F.col("person").alias("o")).agg(F.count("*").alias("overall"))
    unsure = mentions.filter("person IS NULL AND options IS NOT NULL").select("id", "at", "legislature", "rep_id", F.explode("options").alias("o"))
    counted = unsure.join(within, ["legislature", "o"], "left").join(overall, "o", "left").fillna(0, ["within", "overall"])
    some = F.max("within").over(Window.partitionBy("id", "at")) > 0
    counted = counted.withColumn("n", F.when(some, F.col("within")).otherwise(F.col("overall")))
    ranked = counted.groupBy("id", "at").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "o")), False), 1, 2).alias("two"), F.first("rep_id").alias("speaker"))
    first, second = F.col("two")[0], F.coalesce(F.try_element_at("two", F.lit(2))["n"], F.lit(0))
    fits = (first["n"] >= least) & (first["n"] >= times * F.greatest(F.lit(1), second)) & ~F.coalesce(first["o"] == F.col("speaker").cast("string"), F.lit(False))
    chosen = ranked.filter(fits).select("id", "at", first["o"].alias("chosen"))
    out = mentions.join(chosen, ["id", "at"], "left").withColumn("person", F.coalesce("person", "chosen"))
    return out.withColumn("options", F.when(F.col("person").isNull(), F.col("options"))).select(*mentions.columns)


# --- outsiders ---------------------------------------------------------------


def given_names(people: DataFrame, least: int = 2) -> DataFrame:
    """(word): first words of at least ``least`` members' names."""
    return people.groupBy(F.col("words")[0].alias("word")).agg(F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("word").isNotNull()).select("word")


def _tails(keys: DataFrame, given: DataFrame) -> DataFrame:
    """Adds ``surname``: the first word after given names, else the last; the first word of all never is one."""
    places = keys.select("key", "size", F.posexplode("words").alias("at", "word")).filter((F.col("at") > 0) | (F.col("size") == 1))
    after = places.join(given, "word", "left_anti").groupBy("key").agg(F.min(F.struct("at", "word")).alias("m")).select("key", F.col("m.word").alias("tail"))
    return keys.join(after, "key", "left").withColumn("surname", F.coalesce("tail", F.element_at("words", -1))).drop("tail")


def outsider_names(mentions: DataFrame, given: DataFrame, lexicon: Lexicon = DEFAULT, times: int = 3) -> DataFrame:
    """(key, root): under which name each outsider's name goes.

    A name of several words goes to the longest name that begins with it, the
    more often mentioned of equals, or else to the only one that ends with it,
    unless it begins with a given name. Names that were joined so are followed
    to the last. A single word goes to the persons whose surname it is: to the
    only one, or to one with ``times`` the mentions of the next; common surnames
    stay alone. Names meet by equality on their beginnings and endings, so none
    is compared with all others.
    """
    keys = mentions.filter(F.startswith("person", F.lit(_OUT))).groupBy(F.expr(f"substring(person, {len(_OUT) + 1})").alias("key")).agg(F.count("*").alias("n"))
    keys = cut(keys).withColumn("words", F.split("key", " ")).withColumn("size", F.size("words"))
    several = keys.filter("size > 1")
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    longer = several.filter("size > 2").select("key", "n", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    heads = longer.select(joined(F.lit(1), F.col("m")).alias("key"), F.struct("size", "n", F.col("key").alias("to")).alias("c"))
    ends = longer.select(joined(F.col("size") - F.col("m") + 1, F.col("m")).alias("key"), F.col("key").alias("to"))
    begun = several.select("key").join(heads, "key").groupBy("key").agg(F.max("c").alias("c")).select("key", F.col("c.to").alias("begun"))
    ended = ends.join(several.select("key", F.col("words")[0].alias("word")), "key").join(given, "word", "left_anti")
    # endings count only among names that begin no longer one
    ended = ended.join(begun.select(F.col("key").alias("to")), "to", "left_anti").groupBy("key").agg(F.count("*").alias("c"), F.min("to").alias("ended")).filter("c = 1").select("key", "ended")
    up = cut(several.select("key").join(begun, "key", "left").join(ended, "key", "left").select("key", F.coalesce("begun", "ended", "key").alias("root")))
    for _ in range(3):  # each step at least doubles the way; a name has at most eight words, and ways lead to longer ones
        up = up.join(up.select(F.col("key").alias("root"), F.col("root").alias("next")), "root", "left").select("key", F.coalesce("next", "root").alias("root"))
    up = cut(up)
    weights = up.join(keys.select("key", "n"), "key").groupBy("root").agg(F.sum("n").alias("weight"))
    tails = _tails(several, given).select("key", "surname").join(up, "key").select("surname", "root").distinct().join(weights, "root")
    two = tails.groupBy("surname").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("root").alias("to")))), 1, 2).alias("two"))
    clear = (F.size("two") == 1) | (F.col("two")[0]["w"] <= times * F.try_element_at("two", F.lit(2))["w"])
    single = keys.filter("size = 1").select("key").join(two.filter(clear).select(F.col("surname").alias("key"), F.col("two")[0]["to"].alias("to")).filter(~F.col("key").isin(*lexicon.common)), "key", "left")
    return up.unionByName(single.select("key", F.coalesce("to", "key").alias("root")))


def merge_outsiders(mentions: DataFrame, given: DataFrame, lexicon: Lexicon = DEFAULT, times: int = 3) -> DataFrame:
    """``mentions`` with outsiders under one name each.

    A single word that goes to nobody in general is the one person of its session
    whose name has it, after the first word, if there is only one.
    """
    names = outsider_names(mentions, given, lexicon, times).select(F.concat(F.lit(_OUT), "key").alias("person"), F.concat(F.lit(_OUT), "root").alias("root"))
    out = mentions.join(names, "person", "left").withColumn("person", F.coalesce("root", "person")).drop("root")
    words = F.split(F.expr(f"substring(person, {len(_OUT) + 1})"), " ")
    outside = F.coalesce(F.startswith("person", F.lit(_OUT)), F.lit(False))
    alone = outside & ~F.contains("person", F.lit(" "))
    there = out.filter(outside & F.contains("person", F.lit(" "))).select("num_session", "person").distinct()
    there = there.select("num_session", F.explode(F.array_distinct(F.slice(words, 2, F.size(words)))).alias("word"), F.col("person").alias("only"))
    only = there.groupBy("num_session", "word").agg(F.count("*").alias("c"), F.min("only").alias("only")).filter("c = 1").drop("c").join(given, "word", "left_anti")
    out = out.withColumn("word", F.when(alone, words[0])).join(only, ["num_session", "word"], "left")
    return out.withColumn("person", F.coalesce("only", "person")).select(*mentions.columns)


# --- bare surnames -----------------------------------------------------------


def named_in_full(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """(num_session, ord, id, at, surname, person, words): each word after the first that may stand for a person named with two words or more."""
    full = mentions.filter("person IS NOT NULL AND name IS NOT NULL").withColumn("parts", name_words(F.col("name"))).filter(F.size("parts") > 1)
    own = people.select(F.col("rep_id").cast("string").alias("person"), F.col("words").alias("theirs"))
    # who a mention means may be another name than the one in the text
    theirs = F.coalesce("theirs", F.split(F.regexp_replace("person", "^" + _OUT, ""), " "))
    full = full.join(own, "person", "left").withColumn("words", F.array_union("parts", theirs))
    tail = F.explode(F.array_distinct(F.filter(F.slice("parts", 2, F.size("parts")), lambda w: F.char_length(w) > 3)))
    return full.select("num_session", "ord", "id", "at", tail.alias("surname"), "person", "words")


def distinctive(corpus: DataFrame, surnames: DataFrame, lexicon: Lexicon = DEFAULT, most_small: float = 0.05) -> DataFrame:
    """(surname): those that the corpus writes with a capital twice at least and hardly ever in small letters."""
    tokens = F.regexp_extract_all("speech", F.lit(r"[\p{L}]{4,}"), 0)
    words = corpus.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = words.withColumn("surname", fold(F.col("token"))).join(surnames.select("surname").distinct(), "surname", "left_semi")
    large = F.substring("token", 1, 1) != F.lower(F.substring("token", 1, 1))
    counts = words.groupBy("surname").agg(F.sum(F.when(large, F.col("n")).otherwise(0)).alias("large"), F.sum(F.when(large, 0).otherwise(F.col("n"))).alias("small"))
    fits = (F.col("large") >= 2) & (F.col("small") <= F.greatest(F.lit(1.0), most_small * (F.col("large") + F.col("small"))))
    return counts.filter(fits & ~F.col("surname").isin(*lexicon.common)).select("surname")


def loose_surnames(corpus: DataFrame, mentions: DataFrame, capitals: DataFrame, people: DataFrame, lexicon: Lexicon = DEFAULT, least: int = 3) -> DataFrame:
    """Bare surnames as mentions: the person last named in full with that surname in the session, before that place.

    ``capitals`` comes from ``mentions.capitals``. The surname has to be
    distinctive, and named in full ``least`` times in the corpus. Capitalised
    words next to it have to be of the person's name, and of two words of one
    name the first counts. Surnames of the speaker don't. Sessions are walked in
    the order of speeches and places by a window for each surname in them, so
    a long session is many small groups.
    """
    full = named_in_full(mentions, people)
    known = full.groupBy("surname").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    surnames = distinctive(corpus, known, lexicon)
    full = full.join(surnames, "surname", "left_semi")
    here = full.select("num_session", F.col("surname").alias("word")).distinct()
    bare = capitals.join(here, ["num_session", "word"], "left_semi").withColumnRenamed("word", "surname")
    meant = F.struct("person", "words")
    events = bare.withColumn("named", F.lit(None).cast("struct<person:string,words:array<string>>")).unionByName(full.withColumn("named", meant).select("num_session", "ord", "id", "at", "surname", "named"), allowMissingColumns=True)
    order = Window.partitionBy("num_session", "surname").orderBy("ord", "id", "at").rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("last", F.last("named", ignorenulls=True).over(order)).filter("named IS NULL AND last IS NOT NULL").drop("named")

    def own(c: str) -> Column:
        return F.col(c).isNull() | F.array_contains("last.words", F.col(c))

    # the word before, if it is a surname of the same name, was the mention
    twice = F.col("before").isNotNull() & F.exists(F.slice("last.words", 2, F.size("last.words")), lambda w: w == F.col("before"))
    found = found.filter(own("before") & own("after") & ~twice & ~F.coalesce(F.col("last.person") == F.col("rep_id").cast("string"), F.lit(False)))
    return found.withColumn("person", F.col("last.person")).withColumn("name", F.col("surname")).drop("last", "before", "after", "surname")


def all_mentions(corpus: DataFrame, holders: DataFrame | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Every mention of a corpus: candidates, resolved, unsure ones by evidence, outsiders merged, and bare surnames; ``loose`` tells the last."""
    from .mentions import marks, resolve, roster, spread

    people = cut(roster(corpus))
    marked = written(marks(corpus, lexicon))
    found = cut(by_evidence(cut(resolve(spread(marked, "found"), people, holders))))
    sure = cut(merge_outsiders(found, given_names(people), lexicon))
    bare = loose_surnames(corpus, sure, spread(marked, "loose"), people, lexicon)
    return sure.withColumn("loose", F.lit(False)).unionByName(bare.withColumn("loose", F.lit(True)).withColumn("vocative", F.lit(False)), allowMissingColumns=True)
