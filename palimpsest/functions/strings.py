"""String semantics of the pipeline as Catalyst expressions.

White space is Unicode white space with the separators U+001C to U+001F; lines end at any Unicode line
boundary; lengths are code points. Everything here stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line boundaries, as bodies of character classes.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NL = r"\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
S, NS = f"[{WS}]", f"[^{WS}]"
#: The same white space, character by character.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Code points removed as invisible, besides controls other than line feed and tab.
INVISIBLE = r"\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}\x{180e}\x00-\x08\x0b-\x1f\x7f-\x{9f}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line, and an empty text has no lines."""
    return let(F.split(c, rf"\r\n|[{NL}]"), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Letters with marks and the single letters left without them, lower-case; by rule from Unicode's tables."""
    source, target = [], []
    for p in [*range(0xB5, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), 0x2126, 0x212A, 0x212B]:
        c = chr(p)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").casefold()
        if bare != c and len(bare) == 1:
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """Without outer white space, marks and case, for comparisons of lines."""
    source, target = fold_table()
    bare = F.lower(F.translate(F.regexp_replace(strip(c), r"\p{Mn}+", ""), source, target))
    return F.regexp_replace(F.regexp_replace(bare, "ß", "ss"), r"\x{149}", "ʼn")


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def upper_ratio(c: Column) -> Column:
    """Share of capitals among the letters; 0 without letters."""
    n = letters(c)
    return F.when(n > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / n).otherwise(F.lit(0.0))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Filters on a derived column are pushed down with its whole expression; bound values keep that expression
    as small as it is written.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join(c: Column, sep: str) -> Column:
    return F.array_join(c, sep)


def first_index(flags: Column) -> Column:
    """1-based position of the first true flag, 0 if there is none."""
    return F.array_position(flags, True)
