"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton is built over a bounded sample of its
labelled texts. A whole text is cut greedily into phrases, each the longest
piece that occurs in the sample; a letter that doesn't occur is a phrase of its
own. The language that needs the fewest phrases, normalised as
``phrases * log2(sample length) / text length``, wins.

Automata are packed as double arrays, so any number of letters costs no more
than the transitions there are. Texts are cut in blocks that walk side by side:
each block first starts with no phrase open; then blocks whose predecessor left
one open are walked again until they meet their first walk. What is counted are
the phrases of the uncut text, whatever the size of a block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship

SCHEMA = "struct<lang_pred:string,score:double,bits:double,familiar:boolean>"
UNKNOWN = "und"
_SPACE, _OTHER = 0, 1
_SLICE = 1 << 20
#: Places of a batch of blocks, for all languages together.
_BATCH = 1 << 22


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and what the filter keeps.

    The sample of a language is at most ``docs_per_lang`` labelled rows, those
    with the smallest hashes of their ids. Rows of up to ``doc_chars`` characters
    enter it first, then longer ones, the shortest first; all enter whole, as long
    as their texts stay within ``chars_per_lang`` (the first one always does).
    """

    docs_per_lang: int = 100
    #: Walks of texts that are in the sample themselves take time with the length of its rows.
    doc_chars: int = 4_000
    chars_per_lang: int = 120_000
    #: One row of so many is kept back from the automaton; the filter's limit comes from these.
    hold_back: int = 5
    #: Bits a character a kept text may need, against the most of the rows kept back, and phrases granted on top for short texts.
    slack: float = 1.75
    grace: int = 2
    #: Characters of a block; results don't depend on it.
    block: int = 256


class Letters:
    """Folds code points to classes: 0 anything but a letter, 1 a letter in no sample, then letters."""

    def __init__(self, texts: list[str]):
        fold = {c: chr(c).lower()[0] for c in range(0x110000) if chr(c).isalpha()}
        seen = sorted({fold[ord(c)] for t in texts for c in set(t) if ord(c) in fold})
        number = {c: 2 + k for k, c in enumerate(seen)}
        self.table = np.zeros(0x110000, np.int32)
        self.table[list(fold)] = [number.get(c, _OTHER) for c in fold.values()]
        self.size = 2 + len(seen)

    def classes(self, text: str, after_space: bool = False) -> np.ndarray:
        """Classes of a piece of text; runs of non-letters become one space, also across pieces."""
        out = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = out != _SPACE
        keep[1:] |= out[:-1] != _SPACE
        if len(keep) and not after_space:
            keep[0] = True
        return out[keep]


def suffix_automaton(codes: list[int]) -> list[dict]:
    """Transitions of each state of the suffix automaton of ``codes``; state 0 is the root."""
    moves: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class Parser:
    """Table of the automaton of one language.

    State s goes by class c to ``to[base[s] + c]`` if ``owner[base[s] + c]`` is
    s. State 0 stands for no phrase being open: nothing leads on from it, and
    ``first`` has the states that one class leads to.
    """

    def __init__(self, codes: np.ndarray, classes: int):
        moves = suffix_automaton(codes.tolist())
        self.first = np.zeros(classes, np.int32)
        self.first[list(moves[0])] = list(moves[0].values())
        self.base = np.zeros(len(moves), np.int32)
        room = classes + sum(map(len, moves)) * 2
        owner, to = np.full(room + 8192 + classes, -1, np.int32), np.zeros(room + 8192 + classes, np.int32)
        free = np.ones(len(owner), bool)
        low = 0
        for s in sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s])):
            c = np.fromiter(moves[s], np.int64, len(moves[s]))
            at = low
            while True:
                fits = free[at + c[0] : at + c[0] + 4096].copy()
                for k in c[1:]:
                    fits &= free[at + k : at + k + 4096]
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 4096
                if at + 4096 + classes > len(free):
                    free = np.concatenate([free, np.ones(room, bool)])
                    owner, to = np.concatenate([owner, np.full(room, -1, np.int32)]), np.concatenate([to, np.zeros(room, np.int32)])
            self.base[s] = at
            free[at + c] = False
            owner[at + c] = s
            to[at + c] = list(moves[s].values())
            while low + 4096 < at and free[low : low + 4096].sum() < 64:
                low += 4096
        # states with one way on fill the places left
        single = np.array([s for s in range(1, len(moves)) if len(moves[s]) == 1], np.int64)
        c = np.array([next(iter(moves[s])) for s in single], np.int64)
        place = classes + np.flatnonzero(free[classes:])[: len(single)]
        if len(place) < len(single):
            more = len(single) - len(place)
            place = np.concatenate([place, np.arange(len(owner), len(owner) + more)])
            owner, to = np.concatenate([owner, np.full(more, -1, np.int32)]), np.concatenate([to, np.zeros(more, np.int32)])
        self.base[single] = place - c
        owner[place] = single
        to[place] = [next(iter(moves[s].values())) for s in single]
        end = int(self.base.max(initial=0)) + classes
        self.owner = np.concatenate([owner, np.full(classes, -1, np.int32)])[:end]
        self.to = np.concatenate([to, np.zeros(classes, np.int32)])[:end]
        self.bits = math.log2(max(2, len(codes)))


class Walk:
    """Walks of texts through the parsers of all languages at once; states and places of each come after those of the one before."""

    def __init__(self, parsers: list[Parser], classes: int):
        states = np.cumsum([0] + [len(p.base) for p in parsers])
        places = np.cumsum([0] + [len(p.owner) for p in parsers])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.closed = states[:-1]
        self.base = join([p.base + a for p, a in zip(parsers, places, strict=False)])
        self.owner = join([np.where(p.owner < 0, -1, p.owner + a) for p, a in zip(parsers, states, strict=False)])
        self.to = join([p.to + a for p, a in zip(parsers, states, strict=False)])
        self.first = join([p.first + a for p, a in zip(parsers, states, strict=False)])
        self.row = np.arange(len(parsers)) * classes
        self.__setstate__(self.__dict__)

    def __getstate__(self) -> dict:
        """Half as wide for the broadcast."""
        return {k: v.astype(np.int32) for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        """As wide as an index: gathers need no casts."""
        self.__dict__.update({k: v.astype(np.int64) for k, v in state.items()})

    def _step(self, state: np.ndarray, c: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase goes on; ``row`` says of which language ``first`` is."""
        at = self.base.take(state)
        at += c
        on = self.owner.take(at) == state
        return np.where(on, self.to.take(at), self.first.take(c + row)), on

    def phrases(self, codes: np.ndarray, lengths: np.ndarray, before: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin, state at the end) by language and column of ``codes``.

        Columns are sorted by length, the longest first. ``before`` has the column
        that a column continues, or -1 if it is entered with the states ``entry``.
        """
        size, n = codes.shape
        many = len(self.closed)
        entered = np.repeat(self.closed[:, None], n, 1)
        state = entered.copy()
        path, goes_on = np.zeros((size, many, n), np.int32), np.ones((size, many, n), bool)
        for t, wide in enumerate(np.searchsorted(-lengths, -np.arange(size), "left").tolist()):
            state[:, :wide], goes_on[t, :, :wide] = self._step(state[:, :wide], codes[t, :wide], self.row[:, None])
            path[t, :, :wide] = state[:, :wide]
        path, goes_on = path.reshape(size, -1), goes_on.reshape(size, -1)
        entered, state = entered.ravel(), state.ravel()
        while True:
            want = np.where(before >= 0, state.reshape(many, n)[:, before], entry).ravel()
            live = np.flatnonzero(want != entered)
            if not len(live):
                return (~goes_on).sum(0).reshape(many, n), state.reshape(many, n)
            entered[live] = now = want[live]
            column, row = live % n, self.row[live // n]
            shortest = int(lengths[column].min())
            for t in range(size + 1):
                if t >= shortest:
                    done = lengths[column] <= t
                    state[live[done]] = now[done]
                    live, now, column, row = live[~done], now[~done], column[~done], row[~done]
                    if not len(live):
                        break
                now, on = self._step(now, codes[t].take(column), row)
                same = path[t].take(live) == now
                path[t][live], goes_on[t][live] = now, on
                if same.any():
                    apart = ~same
                    live, now, column, row = live[apart], now[apart], column[apart], row[apart]
                    if not len(live):
                        break


class Model:
    """Parsers of all languages, from ``samples``: the whole texts of each."""

    def __init__(self, samples: dict[str, list[str]], settings: Settings = Settings()):
        self.settings = settings
        has_letters = lambda t: any(c.isalpha() for c in t)
        samples = {k: [t for t in v if has_letters(t)] for k, v in samples.items()}
        self.langs = sorted(k for k, v in samples.items() if v)
        self.letters = Letters([t for v in samples.values() for t in v])
        parsers, aside = [], []
        for k in self.langs:
            texts = samples[k]
            fit = [t for i, t in enumerate(texts) if len(texts) < settings.hold_back or i % settings.hold_back]
            parsers.append(Parser(self.letters.classes("\n".join(fit)), self.letters.size))
            aside.append(texts[:: settings.hold_back] if len(texts) >= settings.hold_back else [])
        self.each = np.array([p.bits for p in parsers])
        self.walk = Walk(parsers, self.letters.size)
        self.limits = [math.inf] * len(self.langs)
        for k, texts in enumerate(aside):
            bits = self.bits(texts)[0][k]
            if len(texts):
                self.limits[k] = settings.slack * float(bits.max())

    def _batches(self, texts: list[str | None]):
        """(columns, lengths, owner, column before, continues) of batches of blocks."""
        size = self.settings.block
        most = max(1, _BATCH // (size * max(1, len(self.langs))))
        parts: list[np.ndarray] = []
        owner: list[int] = []
        goes_on = False

        def flush():
            lengths = np.array([len(p) for p in parts])
            order = np.argsort(-lengths, kind="stable")
            columns = np.zeros((len(parts), size), np.int64)
            for k, p in enumerate(parts):
                columns[k, : len(p)] = p
            place = np.empty(len(parts), np.int64)
            place[order] = np.arange(len(parts))
            of = np.array(owner)
            before = np.full(len(parts), -1)
            same = np.flatnonzero(of[1:] == of[:-1])
            before[place[same + 1]] = place[same]
            return np.ascontiguousarray(columns[order].T), lengths[order], of[order], before, place, goes_on

        for i, text in enumerate(texts):
            space = False
            for a in range(0, len(text or ""), _SLICE):
                codes = self.letters.classes(text[a : a + _SLICE], space)
                space = codes[-1] == _SPACE if len(codes) else space
                for b in range(0, len(codes), size):
                    parts.append(codes[b : b + size])
                    owner.append(i)
                    if len(parts) >= most:
                        yield flush()
                        goes_on = True
                        parts, owner = [], []
            if not parts:
                goes_on = False
        if parts:
            yield flush()

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text in each language, its characters, and its letters."""
        n = len(texts)
        count = np.zeros((len(self.langs), n))
        chars, letters = np.zeros(n), np.zeros(n)
        carried, carrier = self.walk.closed, -1
        for columns, lengths, owner, before, place, goes_on in self._batches(texts):
            chars += np.bincount(owner, lengths, n)
            letters += np.bincount(owner, (columns > _SPACE).sum(0), n)
            entry = np.repeat(self.walk.closed[:, None], len(owner), 1)
            if goes_on and owner[place[0]] == carrier:
                entry[:, place[0]] = carried  # the first block continues the last text of the batch before
            found, state = self.walk.phrases(columns, lengths, before, entry)
            for k in range(len(self.langs)):
                count[k] += np.bincount(owner, found[k], n)
            carried, carrier = state[:, place[-1]], owner[place[-1]]
        return count * self.each[:, None] / np.maximum(1, chars), chars, letters

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """(language, score, bits a character, whether that is within the language's limit) of each text."""
        bits, chars, letters = self.bits(texts)
        out = []
        for i in range(len(texts)):
            if not letters[i] or not self.langs:
                out.append((UNKNOWN, 0.0, None, False))
                continue
            order = np.argsort(bits[:, i], kind="stable")
            k, best = int(order[0]), float(bits[order[0], i])
            score = 1.0 if len(order) == 1 else 1 - best / float(bits[order[1], i])
            familiar = best <= self.limits[k] + self.settings.grace * self.each[k] / chars[i]
            out.append((self.langs[k], min(1.0, max(0.0, score)), best, bool(familiar)))
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> dict[str, list[str]]:
    """Whole sample texts of each language, from labelled documents that aren't held out."""
    ours = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ours.select("lang", "doc_id").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= settings.docs_per_lang)
    # docs_per_lang rows for each language at most
    chosen = docs.sparkSession.createDataFrame(chosen.select("lang", "doc_id").distinct().toArrow(), chosen.select("lang", "doc_id").schema)
    long = F.when(F.length("text") > settings.doc_chars, F.length("text")).otherwise(0)
    rows = ours.filter("text IS NOT NULL").join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").withColumn("long", long)
    best = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= settings.docs_per_lang)
    held = F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy("k"))
    rows = rows.withColumn("held", held).filter((F.col("k") == 1) | (F.col("held") <= settings.chars_per_lang))
    texts: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.k)):
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def language(docs: DataFrame, text: Column, settings: Settings) -> Column:
    """Struct column of ``SCHEMA``. The model that is broadcast grows with the languages and the bounds of ``settings`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(train(docs, settings), settings))

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        rows = shared.value.rows(texts.to_pylist())
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "bits": pa.float64(), "familiar": pa.bool_()}
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return run.asNondeterministic()(text)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (margin over the next language), bits, familiar.

    A null text or one without letters, and any text if nothing is labelled,
    gets ``und`` with score 0. Ties between languages go to the first by name.
    Repeated rows each get a row; a null id is neither learnt from nor held out;
    an empty table gives an empty result; other columns aren't read.
    """
    ship(docs.sparkSession)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(docs, F.col("text"), settings).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def filter_language(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without texts in no known language, columns as they were.

    Dropped are ``und`` (null and empty texts among them) and texts that need more
    bits a character than ``slack`` times the most that the language's own texts
    needed that were kept back from its automaton. Repeated rows are judged
    alike; an empty table gives an empty result; extra columns stay, whatever
    their names.
    """
    ship(docs.sparkSession)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), language(docs, F.col("text"), settings).alias("p"))
    return marked.filter((F.col("p.lang_pred") != UNKNOWN) & F.col("p.familiar")).select("row.*")
