"""Words of letters, digits and all beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

_WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """The runs of ``[0-9a-z]`` and code points from 0x80 of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
