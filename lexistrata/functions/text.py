"""Text columns: folding and the four tokenisers. All run inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_pairs() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the plain letters under them."""
    pairs = {}
    for block in (range(0xE0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            c = chr(code)
            base = unicodedata.normalize("NFD", c)
            if len(base) > 1 and base[0].isascii() and c.lower() == c:
                pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _fold_pairs()

#: Python's white space.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
#: Characters between which an expression may not stretch.
_SPAN_CUT = r"[.,;:!?¿¡()\[\]{}«»\"“”„–—…•|\n\t]| {6,}"
_CUT = re.compile(_SPAN_CUT)
_FOLDED = str.maketrans(_MARKED, _PLAIN)


def fold(c: Column) -> Column:
    """Lower case without combining marks."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), r"\p{Mn}", "")


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, SPACE + "+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Size of ``words``, without the array's filter."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE + "+")))


def index_tokens(c: Column) -> Column:
    """Folded runs of letters and digits: the tokens of search, trend and keyness."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def surface_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, marks kept; aligned with ``index_tokens``."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def ascii_tokens(c: Column) -> Column:
    """Folded runs of ASCII letters and digits: the tokens of reply finding."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def spans(c: Column) -> Column:
    """Token arrays of the pieces between punctuation, line breaks and wide gaps."""
    pieces = F.split(F.coalesce(c, F.lit("")), _SPAN_CUT)
    return F.filter(F.transform(pieces, index_tokens), lambda x: F.size(x) > 0)


def tokens_and_cuts(c: Column) -> Column:
    """Lower-case tokens, marks kept, and what cuts ``spans`` between them, from one scan; ``fold_token`` makes the tokens of ``spans`` of them."""
    raw = F.coalesce(c, F.lit(""))
    found = F.regexp_extract_all(F.lower(raw), F.lit(r"[\p{L}\p{N}\p{Mn}]+|" + _SPAN_CUT), 0)
    # how this capital is lowered depends on what stands around it, so the pieces are lowered by themselves
    return F.when(F.contains(raw, F.lit("\u03a3")), F.flatten(F.transform(spans(raw), lambda s: F.array_append(s, F.lit("."))))).otherwise(found)


def is_cut(token: str) -> bool:
    """Whether this is no token, but what cuts spans."""
    return _CUT.match(token) is not None


def fold_token(token: str) -> str:
    """A lower-case token without its marks; empty if it has nothing else."""
    if token.isascii():
        return token
    return "".join(c for c in token.translate(_FOLDED) if unicodedata.category(c) != "Mn")


def explode_tokens(rows: DataFrame, text: str = "speech", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep…, pos, token) of every token."""
    return rows.select(*keep, F.posexplode(index_tokens(F.col(text))).alias("pos", "token"))


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    return F.btrim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))


def guard_formula(c: Column) -> Column:
    """Keeps a spreadsheet from reading a cell as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_markup(c: Column) -> Column:
    """XML and HTML escaping."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def title_name(c: Column) -> Column:
    """Names in capitals to title case, particles in lower case."""
    c = F.initcap(F.lower(c))
    for p in ("De", "Del", "La", "Las", "Los", "Y", "E", "Da", "Das", "Do", "Dos"):
        c = F.regexp_replace(c, rf"(?<=\s){p}(?=\s)", p.lower())
    return c


def contains_phrase(tokens: Column, phrase: list[str]) -> Column:
    """Whether the tokens of a phrase stand in a row."""
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.contains(line, F.lit(" " + " ".join(phrase) + " "))


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase, overlapping ones each."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: x == phrase[0]))
    last = F.size(tokens) - len(phrase)
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, len(phrase)) == F.array(*map(F.lit, phrase))))
