"""Bibliographic metadata from catalogue cards: author, title, ISBN, confidence and slug.

All expressions are native; only slugs of texts with letters beyond Latin go through Python. Null text
counts as a card without fields, so the decision falls back to the file name.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.strings import WS, S, strip

# Letter classes and patterns of the card fields, confidences of the decision.
LETTER = "A-Za-záéíóúäëïöüâêõã"
SMALL = "a-záéíóúäëïöüâêõã"
AUTHOR = rf"([{LETTER}](?:{S}?+[{LETTER}])*+){S}*,{S}*([{LETTER}](?:{S}?+[{LETTER}])*+){S}*,?{S}*\p{{Nd}}{{4}}-\p{{Nd}}{{4}}"
TITLE = rf"([A-ZÀ-Ÿ][{SMALL}]{{2,}}+(?:{S}++[{SMALL}]++)*+){S}*:{S}*([{SMALL}{WS}/\-]{{5,}})"
ISBN_13 = rf"(?iu)ISBN{S}*978[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9])"
ISBN_ANY = rf"(?iu)ISBN{S}*[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9])"
ALL_FIELDS, NO_TITLE, FILENAME = 0.85, 0.73, 0.55


def parse_author(text: Column) -> Column:
    """'First Last' of the first 'Last, First, YYYY-YYYY', spaced-out letters joined; null if a line breaks in it."""
    whole = lambda k: F.regexp_replace(strip(F.regexp_extract(text, AUTHOR, k)), rf"([\p{{L}}\p{{N}}_]){S}+([{SMALL}])", "$1$2")
    name = F.concat(whole(2), F.lit(" "), whole(1))
    return F.when(text.rlike(AUTHOR) & ~F.contains(name, F.lit("\n")), name)


def parse_title(text: Column) -> Column:
    """'Title : subtitle' of the first such pair, the subtitle at most 80 characters."""
    title, rest = strip(F.regexp_extract(text, TITLE, 1)), F.substring(strip(F.regexp_extract(text, TITLE, 2)), 1, 80)
    fits = (F.length(title) > 3) & ~F.contains(F.upper(title), F.lit("ISBN")) & ~F.contains(F.lower(title), F.lit("copyright"))
    return F.when(text.rlike(TITLE) & fits, F.concat(title, F.lit(" : "), rest))


def parse_isbn(text: Column) -> Column:
    """Digits of the first ISBN of 13, else of the first number of at least 10."""
    digits = lambda p: F.concat(*(F.regexp_extract(text, p, k) for k in range(1, 5)))
    long, any_ = F.concat(F.lit("978"), digits(ISBN_13)), digits(ISBN_ANY)
    return F.when(text.rlike(ISBN_13) & (F.length(long) >= 13), long).when(text.rlike(ISBN_ANY) & (F.length(any_) >= 10), any_)


def ascii_table() -> tuple[str, str, str]:
    """Latin letters that decompose to one ASCII letter, those letters, and the other characters below U+0250."""
    source, target, rest = [], [], []
    for p in range(0x80, 0x250):
        c = unicodedata.normalize("NFKD", chr(p)).encode("ascii", "ignore").decode()
        if len(c) == 1:
            source.append(chr(p))
            target.append(c)
        elif not c:
            rest.append(chr(p))
    return "".join(source), "".join(target), "".join(rest)


@F.pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def to_ascii(text: Column) -> Column:
    source, target, rest = ascii_table()
    plain = rf"[^\x00-\x7f{source}{rest}]"
    return F.coalesce(_ascii(F.when(text.rlike(plain), text)), F.translate(text, source + rest, target))


def slug_part(text: Column, most: int) -> Column:
    """ASCII, lower-case, everything but letters, digits and underscores as single hyphens, at most ``most`` long."""
    s = F.regexp_replace(F.regexp_replace(F.lower(to_ascii(text)), r"[^a-z0-9_-]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(s, r"\A-+|-+\z", ""), 1, most)


def book_slug(author: Column, title: Column, isbn: Column) -> Column:
    return F.substring(F.concat_ws("-", slug_part(author, 30), slug_part(title, 40), F.substring(isbn, 1, 10)), 1, 80)


def file_stem(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(filename, r"([^/]*)\z", 1), r"(?<=[^/])\.[^./]*\z", "")


def extract_metadata(df: DataFrame, text_col: str, filename_col: str) -> DataFrame:
    """``df`` with source, author, title, isbn, slug and confidence (prefix ``meta_``)."""
    n = lambda name: f"__pal_{name}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(n("a"), parse_author(text)).withColumn(n("t"), parse_title(text)).withColumn(n("i"), parse_isbn(text))
    a, t, i = (F.col(n(x)) for x in "ati")
    whole, short = a.isNotNull() & t.isNotNull() & i.isNotNull(), a.isNotNull() & t.isNull() & i.isNotNull()
    card = whole | short
    return df.withColumns({
        "meta_source": F.when(card, "ficha_catalografica").otherwise("filename"), "meta_author": F.when(card, a), "meta_title": F.when(whole, t), "meta_isbn": F.when(card, i),
        "meta_slug": F.when(card, book_slug(a, t, i)).otherwise(slug_part(file_stem(F.col(filename_col)), 120)), "meta_confidence": F.when(whole, ALL_FIELDS).when(short, NO_TITLE).otherwise(FILENAME),
    }).drop(*(n(x) for x in "ati"))
