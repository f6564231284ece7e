"""The search language: words, quoted phrases, ``+`` or blank for AND, ``|`` for OR, parentheses.

Text goes to tokens, to a tree, to a simplified tree, to a Column over the token
array of a row. AND binds tighter than OR. A word that holds punctuation is a
phrase of its tokens.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_phrase

#: Words that an AND leaves out beside others.
STOP_WORDS = frozenset("a al and con da das de del do dos e el en in la las lo los o of para por que se the to un una y".split())
_TOKEN = re.compile(r'"(?P<phrase>[^"]*)"|(?P<open>")|(?P<op>[+|()])|(?P<star>\*)|(?P<word>[^\s"+|()*]+)')
_QUOTES = str.maketrans(dict.fromkeys("«»“”„", '"'))


class QueryError(ValueError):
    """A query that can't be read; ``code`` says why and ``at`` where."""

    def __init__(self, code: str, at: int):
        super().__init__(f"{code} at {at}")
        self.code, self.at = code, at


@dataclass(frozen=True)
class Leaf:
    tokens: tuple[str, ...]
    protected: bool = False


@dataclass(frozen=True)
class Group:
    op: str
    parts: tuple


@dataclass
class Query:
    """A read query: tree (None if nothing is left), notices by kind."""

    tree: Leaf | Group | None
    omitted: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)

    def terms(self) -> list[tuple[str, ...]]:
        """Distinct phrases in order of appearance."""
        out: list = []

        def walk(n):
            if isinstance(n, Leaf):
                out.append(n.tokens)
            elif n is not None:
                for p in n.parts:
                    walk(p)

        walk(self.tree)
        return list(dict.fromkeys(out))

    def text(self) -> str:
        """The query as it was understood."""

        def say(n, inner=False):
            if isinstance(n, Leaf):
                return n.tokens[0] if len(n.tokens) == 1 else '"' + " ".join(n.tokens) + '"'
            line = (" " if n.op == "and" else " | ").join(say(p, True) for p in n.parts)
            return f"({line})" if inner else line

        return "" if self.tree is None else say(self.tree)


def fold_text(text: str) -> str:
    flat = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in flat if unicodedata.category(c) != "Mn")


def tokenise(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", fold_text(text)))


def _lex(text: str) -> list[tuple[str, str, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            raise QueryError("unclosed_quotes", m.start())
        if kind == "star":
            raise QueryError("asterisk", m.start())
        if kind == "phrase" and not m["phrase"].strip():
            raise QueryError("empty_quotes", m.start())
        if kind == "word" and m["word"] in ("AND", "OR", "NOT"):
            raise QueryError("operator_word", m.start())
        out.append((kind, m[kind], m.start()))
    return out


class _Reader:
    def __init__(self, text: str):
        self.items, self.at, self.end = _lex(text), 0, len(text)

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else ("end", "", self.end)

    def next(self):
        item = self.peek()
        self.at += 1
        return item

    def either(self):
        parts = [self.all()]
        while self.peek()[:2] == ("op", "|"):
            self.next()
            parts.append(self.all())
        return parts[0] if len(parts) == 1 else Group("or", tuple(parts))

    def all(self):
        parts = [self.one()]
        while True:
            kind, text, _ = self.peek()
            if (kind, text) == ("op", "+"):
                self.next()
            elif kind == "end" or (kind == "op" and text in "|)"):
                return parts[0] if len(parts) == 1 else Group("and", tuple(parts))
            parts.append(self.one())

    def one(self):
        kind, text, at = self.next()
        if kind in ("word", "phrase"):
            return Leaf(tokenise(text)) if tokenise(text) else Leaf((), False), text
        if (kind, text) == ("op", "("):
            if self.peek()[:2] == ("op", ")"):
                raise QueryError("empty_parentheses", at)
            inner = self.either()
            if self.next()[:2] != ("op", ")"):
                raise QueryError("unbalanced", at)
            return Group("group", (inner,))
        if (kind, text) == ("op", ")"):
            raise QueryError("unbalanced", at)
        raise QueryError("operator_at_end" if kind == "end" else "operator_place", at)


@lru_cache(maxsize=64)
def parse(text: str) -> Query:
    """Reads a query; raises ``QueryError`` where it can't."""
    text = unicodedata.normalize("NFC", text).translate(_QUOTES)
    reader = _Reader(text)
    if not reader.items:
        raise QueryError("nothing_to_search", 0)
    tree = reader.either()
    if reader.peek()[0] != "end":
        raise QueryError("unbalanced", reader.peek()[2])
    q = Query(None)
    q.tree = _simplify(tree, q)
    if q.tree is None:
        raise QueryError("nothing_to_search", 0)
    return q


def _simplify(node, q: Query, protected: bool = False):
    if isinstance(node, tuple):  # (leaf, its text)
        leaf, text = node
        if not leaf.tokens:
            q.ignored.append(text)
            return None
        return Leaf(leaf.tokens, protected)
    if node.op == "group":
        inner = node.parts[0]
        return _simplify(inner, q, isinstance(inner, tuple))
    parts = []
    for p in node.parts:
        p = _simplify(p, q)
        if p is not None:
            parts += p.parts if isinstance(p, Group) and p.op == node.op else [p]
    if node.op == "and":
        weak = [p for p in parts if isinstance(p, Leaf) and len(p.tokens) == 1 and not p.protected and p.tokens[0] in STOP_WORDS]
        if weak and len(weak) < len(parts):
            q.omitted += [p.tokens[0] for p in weak]
            parts = [p for p in parts if p not in weak]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else Group(node.op, tuple(parts))


def predicate(q: Query, tokens: Column) -> Column:
    """Condition over an array of index tokens."""

    def build(n) -> Column:
        if isinstance(n, Leaf):
            return contains_phrase(tokens, list(n.tokens))
        parts = [build(p) for p in n.parts]
        return reduce((lambda a, b: a & b) if n.op == "and" else (lambda a, b: a | b), parts)

    return F.lit(False) if q.tree is None else build(q.tree)
