"""URL allow and block lists as a trie over reversed host labels and path segments.

A rule (verdict, "host/path") fits its host and all its subdomains if the URL's
path starts with the rule's path. Of the rules that fit, the one with the most
host labels wins, then the one with the longest path; between an allow and a
block entry for the same place, block wins. URLs that no rule fits get the
default verdict.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

SCHEMA = "struct<host:string,path:string,rule:string,verdict:string>"
#: ASCII only: other letters of a host stay as they are.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass
class _Node:
    """One host label or one whole path segment."""

    labels: dict = field(default_factory=dict)
    segments: dict = field(default_factory=dict)
    #: (start of the next segment, rule, verdict), longest start first
    ends: list = field(default_factory=list)


class UrlTrie:
    def __init__(self, rules: list[tuple[str, str]]):
        self.root = _Node()
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            if not slash:
                node.ends.append((None, rule, verdict))
                continue
            *whole, start = path.split("/")
            for segment in ["", *whole]:
                node = node.segments.setdefault(segment, _Node())
            node.ends.append((start, rule, verdict))
        self._sort(self.root)

    def _sort(self, node: _Node) -> None:
        node.ends.sort(key=lambda e: (-len(e[0] or ""), e[2] != "block"))
        for child in [*node.labels.values(), *node.segments.values()]:
            self._sort(child)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        if not host:
            return None
        best, node = None, self.root
        parts = path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._path(node, parts) or best
        return best

    @staticmethod
    def _path(node: _Node, parts: list[str]) -> tuple[str, str] | None:
        best = next(((r, v) for start, r, v in node.ends if start is None), None)
        for k, segment in enumerate(parts[:-1]):
            node = node.segments.get(segment)
            if node is None:
                break
            best = next(((r, v) for start, r, v in node.ends if start is not None and parts[k + 1].startswith(start)), best)
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, path then up to ``? #``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].translate(_LOWER), rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:end]


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The trie is broadcast; its size is that of the given rule list, whatever
    the table's. A null URL or one without ``://`` has an empty host and path,
    no rule and the default verdict. Repeated rows each get a row, null ids
    stay null, an empty table gives an empty result, other columns aren't read.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.arrow_udf(SCHEMA)
    def run(urls: pa.Array) -> pa.Array:
        trie, rows = shared.value, []
        for url in urls.to_pylist():
            host, path = split_url(url)
            rule, verdict = trie.find(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in cols], ["host", "path", "rule", "verdict"])

    url: Column = F.col("url")
    return pages.select("page_id", run(url).alias("u")).select("page_id", "u.*")
