"""Corpus filters: dimensions, ranges, sets of ids, collections."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

DIMENSIONS = ("legislature", "legislative_session", "session_type", "sex", "party", "district", "rep_id", "speaker")


@dataclass(frozen=True)
class Filters:
    """Conditions that all have to hold; an empty one says nothing."""

    legislature: tuple = ()
    legislative_session: tuple = ()
    session_type: tuple = ()
    sex: tuple = ()
    party: tuple = ()
    district: tuple = ()
    rep_id: tuple = ()
    speaker: tuple = ()
    date_from: str | None = None
    date_to: str | None = None
    min_words: int | None = None
    max_words: int | None = None
    num_session: int | None = None
    exclude_docs: bool = False

    @classmethod
    def from_dict(cls, given: dict) -> Filters:
        """Unknown keys and null, '' and [] values are ignored; a wrong type raises."""
        out = {}
        for f in fields(cls):
            v = given.get(f.name)
            if v is None or v == "" or v == []:
                continue
            if f.name in DIMENSIONS:
                out[f.name] = tuple(v) if isinstance(v, list | tuple) else (v,)
            elif f.name == "exclude_docs":
                if not isinstance(v, bool):
                    raise ValueError(f"{f.name} must be true or false")
                out[f.name] = v
            elif f.name.startswith("date"):
                out[f.name] = str(v)
            else:
                if isinstance(v, bool) or not isinstance(v, int):
                    raise ValueError(f"{f.name} must be an integer")
                out[f.name] = v
        return cls(**out)

    def condition(self) -> Column:
        c = F.lit(True)
        for d in DIMENSIONS:
            if getattr(self, d):
                c = c & F.col(d).isin(*getattr(self, d))
        for ok, column, value in ((">=", "date", self.date_from), ("<=", "date", self.date_to), (">=", "nwords", self.min_words), ("<=", "nwords", self.max_words)):
            if value is not None:
                c = c & (F.col(column) >= value if ok == ">=" else F.col(column) <= value)
        if self.num_session is not None:
            c = c & (F.col("num_session") == self.num_session)
        if self.exclude_docs:
            c = c & (F.col("dm_speech") == 1)
        return c


def apply(corpus: DataFrame, filters: Filters, ids: DataFrame | None = None, collection: DataFrame | None = None) -> DataFrame:
    """Rows that pass; each given set of ids is a semi-join (an empty collection keeps nothing)."""
    out = corpus.filter(filters.condition())
    for chosen in (ids, collection):
        if chosen is not None:
            out = out.join(chosen.select("id"), "id", "left_semi")
    return out


def same_session(a: Column, b: Column) -> Column:
    """Null-safe equality of session keys."""
    return a.eqNullSafe(b)


def period(month_from: str, month_to: str) -> Column:
    """Rows of the months, by their dates."""
    return F.substring("date", 1, 7).between(month_from, month_to)


def facet_values(facet: DataFrame, needle: str, column: str = "value") -> DataFrame:
    """Facet rows whose value holds the needle, whatever the case and marks."""
    return facet.filter(F.contains(fold(F.col(column)), fold(F.lit(needle))))


def preview(speech: Column, size: int = 320) -> Column:
    return F.translate(F.substring(speech, 1, size), "\n", " ")


def long_text(speech: Column, nwords: Column, least: int) -> Column:
    """The text only of speeches long enough."""
    return F.when(nwords >= least, speech)
