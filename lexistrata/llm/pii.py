"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and
cue words of identifiers. From each anchor a deterministic parser expands to
the boundaries of a candidate and validates it, in time linear in the text.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` follow fixed patterns, matched
leftmost and without overlap, and dropped if they don't validate. ``address``
(a web address that carries user information or an IPv6 host) and ``account``
(an identifier after a cue such as ``iban:`` or ``password=``, or with an issuer's
prefix) come from the other anchors. After ``iban`` groups of four letters or
digits are read together, up to the last at which the check digits are right.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}

# Cue words before an identifier, and prefixes that issuers give keys.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "user id", "userid", "member id", "customer id", "license no", "licence no", "password", "passwd", "secret", "token", "api_key", "api key", "apikey")
PREFIXES = ("akia", "ghp_", "xoxb-", "sk_live_")

_AT_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
_SEPARATOR = re.compile(r"(?: ?(?:no|nr|number|num|id)\b\.?)?[ \t]{0,2}(?:[:=#][ \t]{0,2})?[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9]|[-_ ](?=[0-9]))*")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]{1,4}(?![A-Za-z0-9])|[ -]?[A-Za-z0-9]{4})*")
_KEY = re.compile(r"[A-Za-z0-9_-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _anchors():
    """The automaton; values are (anchor, length), the longest at an end first."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("://", 3))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for w in CUES:
        a.add_word(w, ("cue", len(w)))
    for w in PREFIXES:
        a.add_word(w, ("key", len(w)))
    a.make_automaton()
    return a


_AUTOMATON: list = []
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    if not _AUTOMATON:
        _AUTOMATON.append(_anchors())
    out: list[tuple[str, int, int]] = []
    email_end = chain_end = card_end = phone_end = 0
    folded = text.lower()
    if len(folded) != len(text):  # a letter whose lower case is longer
        folded = text.translate(_ASCII_LOWER)
    for last, (kind, size) in _AUTOMATON[0].iter(folded):
        at = last - size + 1
        if kind == "0":
            if at >= chain_end:
                chain_end = _ips(text, at, out)
            if at >= card_end:
                card_end = _card(text, at, out)
        elif kind == "@":
            email_end = _email(text, at, email_end, out)
        elif kind == "+":
            if at >= phone_end:
                phone_end = _phone(text, at, out)
        elif kind == "://":
            _address(text, at, out)
        elif kind == "cue":
            _account(text, at, last + 1, folded[at : last + 1], out)
        else:
            _issued(text, at, out)
    out = list(dict.fromkeys(out))
    out.sort(key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    return out


def _email(text: str, at: int, floor: int, out: list) -> int:
    start = at
    while start > floor and text[start - 1] in _AT_LOCAL:
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at + 1)):
        return floor
    out.append(("email", start, m.end()))
    return m.end()


def _ips(text: str, at: int, out: list) -> int:
    """All addresses of the chain of dotted numbers from ``at``; where the chain ends."""
    end = _CHAIN.match(text, at).end()
    if text.find(".", at, end) < 0:
        return end
    parts = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, at, end)]
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(d := text[a:b].lstrip("0")) < 4 and int(d or "0") < 256 for a, b in four):
            out.append(("ip", four[0][0], four[3][1]))
    return end


def _card(text: str, at: int, out: list) -> int:
    m = _CARD.match(text, at)
    if not m:
        return at + 1
    digits = re.sub("[ -]", "", m.group())
    if 14 <= len(digits) <= 19 and luhn(digits):
        out.append(("card", at, m.end()))
    return m.end()


def _phone(text: str, at: int, out: list) -> int:
    m = _PHONE.match(text, at)
    if not m:
        return at + 1
    if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
        out.append(("phone", at, m.end()))
    return m.end()


def _address(text: str, at: int, out: list) -> None:
    start = at
    while start > 0 and at - start < 32 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    m = _AUTHORITY.match(text, at + 3)
    if start == at or not m:
        return
    user, sign, host = m.group().rpartition("@")
    v6 = re.fullmatch(r"\[[0-9A-Fa-f:.]+\](:[0-9]+)?", host)
    if (sign and user and host) or v6:
        out.append(("address", start, m.end()))


def _iban_end(text: str, start: int) -> int:
    """Where the longest valid account number from ``start`` ends; -1 if there is none."""
    m = _IBAN.match(text, start, start + 45)
    end = m.end() if m else -1
    while end > start:
        number = re.sub("[ -]", "", text[start:end]).upper()
        if len(number) < 15:
            return -1
        if len(number) <= 34 and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1:
            return end
        # back to the end of the group before, or to none
        end = max(text.rfind(" ", start, end), text.rfind("-", start, end))
    return -1


def _account(text: str, at: int, end: int, cue: str, out: list) -> None:
    if at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return
    start = _SEPARATOR.match(text, end).end()
    if start == end:
        return
    if cue == "iban" and (stop := _iban_end(text, start)) > 0:
        out.append(("account", start, stop))
        return
    m = _VALUE.match(text, start)
    if m and len(m.group()) >= 6 and sum(c.isdigit() for c in m.group()) >= 4:
        out.append(("account", start, m.end()))


def _issued(text: str, at: int, out: list) -> None:
    if at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return
    m = _KEY.match(text, at)
    if len(m.group()) >= 16 and any(c.isdigit() for c in m.group()):
        out.append(("account", at, m.end()))


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def row(text: str | None) -> tuple:
    """(n_email, n_ip, n_card, n_phone, base_sha256, spans) of one text."""
    from hashlib import sha256

    found = spans(text or "")
    base = [s for s in found if s[0] in BASE]
    return *(sum(s[0] == k for s in base) for k in BASE), sha256(_joined(base).encode()).hexdigest(), _joined(found)


def mask(text: str | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by its first kind."""
    found = spans(text) if text else []
    if not found:
        return text
    out, at, k = [], 0, 0
    while k < len(found):
        kind, a, b = found[k]
        while k + 1 < len(found) and found[k + 1][1] < b:
            k += 1
            b = max(b, found[k][2])
        out += [text[at:a], f"<{kind.upper()}>"]
        at, k = b, k + 1
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans.

    A null text counts as empty and has no spans. Repeated rows each get a row,
    null ids stay null, an empty table gives an empty result, other columns
    aren't read.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def run(texts: pa.Array) -> pa.Array:
        cols = list(zip(*(row(x) for x in texts.to_pylist()), strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f"n_{k}" for k in BASE] + ["base_sha256", "spans"])

    return docs.select("doc_id", run(F.col("text")).alias("p")).select("doc_id", "p.*")


def masked(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([mask(x) for x in texts.to_pylist()], pa.string())

    return run(text)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of each text replaced by ``<KIND>``; n_chars follows the new text.

    Null and empty texts stay as they are; each of repeated rows is masked; an
    empty table gives an empty result; extra columns stay, whatever their names.
    """
    ship(docs.sparkSession)
    size = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return docs.withColumn("text", masked(F.col("text"))).withColumn("n_chars", size)
