"""Byte tables of the encodings that text is wrongly decoded with, and sequences that UTF-8 left in them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Names of single-byte encodings, as Python knows them: that UTF-8 is shown in, that single bytes are shown in, and that they were meant in.
WRONG = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15"]
WRONG_BYTES = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250"]
RIGHT = ["cp1252", "mac_roman", "cp850", "cp437"]


@lru_cache(maxsize=None)
def high(name: str) -> dict[str, int]:
    """Characters of the bytes from 0x80, where undefined bytes stay controls of the same number."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        if b < 0xA0:
            out[chr(b)] = b
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def plausible(c: str) -> bool:
    """Whether a decoded character is one that European text holds: a letter of it, a sign, a space."""
    p = ord(c)
    return 0xA0 <= p < 0x250 or 0x300 <= p < 0x460 or 0x2010 <= p < 0x2060 or p in (0x20AC, 0x2122, 0x200B, 0x200D, 0xFEFF, 0xFB01, 0xFB02)


@lru_cache(maxsize=None)
def utf8_pattern(name: str) -> re.Pattern:
    """Two- and three-byte UTF-8 sequences as the encoding shows them."""
    by: dict[str, list[str]] = {"two": [], "three": [], "next": []}
    for c, b in high(name).items():
        for kind, lo, hi in (("two", 0xC2, 0xDF), ("three", 0xE0, 0xEF), ("next", 0x80, 0xBF)):
            if lo <= b <= hi:
                by[kind].append(re.escape(c))
    two, three, more = ("[" + "".join(by[k]) + "]" for k in ("two", "three", "next"))
    return re.compile(f"{two}{more}|{three}{more}{more}")


def decoded(seq: str, name: str) -> str | None:
    """What a sequence stood for, if its bytes are valid UTF-8 for a plausible character."""
    table = high(name)
    try:
        c = bytes(table[x] for x in seq).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return c if all(map(plausible, c)) else None


@lru_cache(maxsize=1)
def _leads() -> re.Pattern:
    """Any byte that can begin a UTF-8 sequence, in any of the encodings, followed by a non-ASCII character."""
    leads = {c for n in WRONG for c, b in high(n).items() if 0xC2 <= b <= 0xEF}
    return re.compile("[" + "".join(map(re.escape, sorted(leads))) + "][^\x00-\x7f]")


def may_be_garbled(text: str) -> bool:
    return _leads().search(text) is not None


@lru_cache(maxsize=100_000)
def _ordinary(pair: str) -> bool:
    """Letters that follow each other in ordinary words, as in 'ção' or 'ÇÃO'; no evidence of garbling."""
    return all(c.isalpha() and "LATIN" in unicodedata.name(c, "") and ord(c) < 0x180 for c in pair) and (pair.islower() or pair.isupper() or pair.istitle())


def garbled_spans(text: str) -> list[tuple[int, int]]:
    """Ranges of the text that are UTF-8 sequences shown in a wrong encoding, without overlaps."""
    spans: list[tuple[int, int]] = []
    for name in WRONG:
        for m in utf8_pattern(name).finditer(text):
            if not _ordinary(m[0]) and decoded(m[0], name) is not None:
                spans.append(m.span())
    spans.sort()
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
