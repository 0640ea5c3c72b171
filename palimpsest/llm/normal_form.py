"""One consistent form for visually identical text.

A quick check finds the characters that may be unstable: wide forms and ligatures, marks that may
compose, invisible characters, spaces other than U+0020, and letters of another script. Text without
any of them is already in its form and is never touched. Around each such character a segment is cut
at stable boundaries, only the segment is normalised, and it is spliced back into the unchanged text.

The form: wide letters, digits and signs become ordinary ones; ligatures are spelled out; letter and
accent compose (NFC); invisible characters vanish; every space is U+0020; in a word with Latin letters
the look-alikes of other scripts become Latin. Characters inside a garbled sequence (decoded with the
wrong encoding) are left to the operator for those.

Null stays null, empty stays empty; both count nothing. Repeated rows are treated alike. Input columns
are kept, and the results are added under the given prefix.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encodings import garbled_spans, may_be_garbled

KINDS = ("wide", "composed", "invisible", "space", "script")

# Code point ranges that Unicode lists as default-ignorable.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЇЈКМНОРСТУХԚԜаеѕіїјорсухԛԝһԁьүѵӏкмнтв", "ABESIÏJKMHOPCTYXQWaesiïjopcyxqwhdbyvlkmhtb"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχϲϳγωόάέίύ", "ABEZHIKMNOPTYXaeikvoptuxcjywóáéíú"),
    "Armenian": ("ՕՍԼօսոհզցյ", "OULounhqgj"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏆᏎᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZTSSLCPKB"),
}
FOLD = {a: b for own, latin in LOOK_ALIKES.values() for a, b in zip(own, latin, strict=True)}


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[set[int], set[int], set[int], set[int]]:
    """Code points that are wide or ligatures, may compose or decompose, are invisible, are spaces."""
    wide, maybe, spaces = set(), set(), set()
    ignorable = {p for lo, hi in IGNORABLE for p in range(lo, hi + 1)}
    for p in range(0x80, 0x20000):
        if 0xAC00 <= p <= 0xD7FF or 0xD800 <= p <= 0xF8FF:
            continue
        c = chr(p)
        parts = unicodedata.decomposition(c)
        if parts.startswith("<wide>") and p != 0x3000 or 0xFB00 <= p <= 0xFB06:
            wide.add(p)
        elif parts and not parts.startswith("<"):
            own = [int(x, 16) for x in parts.split()]
            if len(own) == 2:
                maybe.add(own[1])
            if not unicodedata.is_normalized("NFC", c):
                maybe.add(p)
        if unicodedata.combining(c):
            maybe.add(p)
        if unicodedata.category(c) == "Zs":
            spaces.add(p)
    return wide, maybe - wide - spaces, ignorable, spaces


@lru_cache(maxsize=1)
def unstable_ranges() -> list[tuple[int, int]]:
    wide, maybe, ignorable, spaces = _tables()
    scripts = set(range(0x370, 0x590)) | set(range(0x13A0, 0x1400)) | set(range(0x1F00, 0x2000)) | set(range(0x2C80, 0x2D00))
    return _ranges(sorted(wide | maybe | ignorable | spaces | scripts))


@lru_cache(maxsize=1)
def quick_check() -> str:
    """A character class, in the syntax of Java's regular expressions, that holds every unstable character.

    It names the wide stable ranges and negates them, ASCII first: a class of all unstable ranges is
    fifty times slower, and letting a stable rarity pass to the full check costs nothing.
    """
    stable, at = [], 0
    for lo, hi in [*unstable_ranges(), (0x110000, 0x110000)]:
        if lo - at >= (4 if at < 0x300 else 16 if 0x2000 <= at < 0x2D00 else 0x200):
            stable.append((at, lo - 1))
        at = hi + 1
    return "[^" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in stable) + "]"


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" if lo < hi else chr(lo) for lo, hi in unstable_ranges()) + "]")


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    """LATIN, GREEK, ... for letters; empty for marks, digits, signs and letter-like signs."""
    if not c.isalpha() or c in "ªºµ":
        return ""
    return unicodedata.name(c, "").partition(" ")[0]


def _inside(c: str) -> bool:
    return c.isalpha() or unicodedata.combining(c) > 0 or ord(c) in _tables()[2]


def normalize(text: str) -> tuple[str, dict[str, int]]:
    """The text in its form, and how many characters of each kind were changed."""
    counts = dict.fromkeys(KINDS, 0)
    hits = [m.start() for m in _unstable().finditer(text)]
    if not hits:
        return text, counts
    wide, _, ignorable, spaces = _tables()
    shielded = garbled_spans(text) if may_be_garbled(text) else []
    out: list[str] = []
    done = k = s = 0
    while k < len(hits):
        p = hits[k]
        while s < len(shielded) and shielded[s][1] <= p:
            s += 1
        if s < len(shielded) and shielded[s][0] <= p:
            k += 1
            continue
        lo, hi = p, p + 1
        if ord(text[p]) not in spaces:
            wall_lo = max(done, shielded[s - 1][1] if s else 0)
            wall_hi = shielded[s][0] if s < len(shielded) else len(text)
            while lo > wall_lo and _inside(text[lo - 1]):
                lo -= 1
            while hi < wall_hi and _inside(text[hi]):
                hi += 1
            if lo > wall_lo and unicodedata.combining(text[lo]):
                lo -= 1
        out.append(text[done:lo])
        out.append(_segment(text[lo:hi], counts, wide, ignorable, spaces))
        done = hi
        while k < len(hits) and hits[k] < hi:
            k += 1
    out.append(text[done:])
    return "".join(out), counts


def _segment(part: str, counts: dict[str, int], wide: set[int], ignorable: set[int], spaces: set[int]) -> str:
    kept: list[str] = []
    for c in part:
        p = ord(c)
        if p < 0x80:
            kept.append(c)
        elif p in ignorable:
            counts["invisible"] += 1
        elif p in spaces:
            counts["space"] += 1
            kept.append(" ")
        elif p in wide:
            plain = unicodedata.normalize("NFKC", c)
            counts["wide"] += plain.isalnum()
            kept.append(plain)
        else:
            kept.append(c)
    bare = "".join(kept)
    if any(unicodedata.combining(c) for c in bare):
        full = unicodedata.normalize("NFC", bare)
        counts["composed"] += sum(map(lambda c: unicodedata.combining(c) > 0, bare)) - sum(map(lambda c: unicodedata.combining(c) > 0, full))
        bare = full
    else:
        bare = unicodedata.normalize("NFC", bare)
    scripts = {script(c) for c in bare} - {""}
    if "LATIN" in scripts and len(scripts) > 1:
        counts["script"] += sum(script(c) not in ("", "LATIN") for c in bare)
        bare = "".join(FOLD.get(c, c) for c in bare)
    return bare


def is_unstable(col: Column) -> Column:
    return F.coalesce(col.rlike(quick_check()), F.lit(False))


SCHEMA = "struct<text:string, " + ", ".join(f"{k}:int" for k in KINDS) + ">"


def normalized(df: DataFrame, text_col: str, *, prefix: str = "nf_") -> DataFrame:
    """``df`` with ``<prefix>text`` in its form and ``<prefix><kind>`` counts.

    Only unstable texts reach Python: the others enter the function as null and come back as they were.
    """

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(None, *[0] * len(KINDS)) if t is None else (lambda r: (r[0], *r[1].values()))(normalize(t)) for t in part]
            yield pd.DataFrame(rows, columns=["text", *KINDS])

    own = f"{prefix}__"
    with_own = df.withColumn(own, run(F.when(is_unstable(F.col(text_col)), F.col(text_col))))
    cols = {f"{prefix}text": F.coalesce(F.col(f"{own}.text"), F.col(text_col)), **{f"{prefix}{k}": F.col(f"{own}.{k}") for k in KINDS}}
    return with_own.withColumns(cols).drop(own)


def found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of the rows that hold a character with an ordinary look-alike; stable rows end at the quick check."""
    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).filter(is_unstable(F.col("text")))
    marked = normalized(rows, "text")
    return marked.filter(" + ".join(f"nf_{k}" for k in KINDS) + " > 0").select("record_id")
