"""Cleanup of extracted book text, one row per document, without a shuffle.

Every step is a Catalyst expression over the document's string or its arrays of pages and lines; loops
that take lines off page edges are prefix and suffix conditions. Only two steps leave the JVM, and only for the rows
that need them: canonical composition of texts that may hold decomposed letters, and the similarity of pages that bear
the same printed number. ``enhanced`` adds headers at page ends, hyphen marks of native text layers and
protected table-of-contents lines.

Null text gives null text, null counters and null warnings. Columns of the input are kept; results are
``<prefix>text``, ``<prefix>stats`` and ``<prefix>warnings``.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.strings import INVISIBLE, NL, NS, WS, S, first_index, fold, join, let, rstrip, split_lines, straight_quotes, strip

# The patterns of the cleanup rules.
PAGE_MARKER = rf"(?md)^{S}*--{S}*\p{{Nd}}+{S}+of{S}+\p{{Nd}}+{S}*--{S}*$"
PAGE_NUMBER = r"\A\p{Nd}{1,4}\z"
EDGE_GARBAGE = r"\A[^\p{L}\p{N}_À-ÿ]\z"
GARBAGE_LINE = rf"\A{S}*[—-]*<[-—<>]+"
LEADING_NUMBER = rf"\A(\p{{Nd}}{{1,4}}){S}+([^\n]+)\z"
TRAILING_NUMBER = rf"\A([^\n]*{NS}){S}+\p{{Nd}}{{1,4}}\z"
ISOLATED_BAR = rf"\|(?![^{WS}])(?<![^{WS}]\|)"
EMBEDDED_SECTION = rf"(?<=[.!?»]){S}++(?=\p{{Nd}}{{1,2}}\.{S}+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ])"
INLINE_NUMBER = rf"\A{S}*\p{{Nd}}{{1,4}}{S}+(?=[a-zà-ÿ])"
LINE_HYPHEN = r"(?:(?<![A-Za-zÀ-ÿ])|\G)([A-Za-zÀ-ÿ]++)-\n([a-zà-ÿ])"
TOC_LINE = rf"(?:[.…]{S}*[.…][.…{WS}]*+|,){S}*\p{{Nd}}{{1,4}}{S}*;?{S}*\z"

STATS = [
    "chars_in", "chars_out", "page_markers_removed", "headers_removed", "page_numbers_removed", "edge_garbage_removed", "pages_processed", "leading_pages_dropped", "duplicate_pages_removed", "isolated_bars_removed",
    "embedded_sections_split", "inline_page_numbers_removed", "garbage_lines_removed", "invisible_removed", "hyphenations_joined", "replacement_chars",
]
SIMILAR = 0.55


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _matches_short(s: Column, most: int, pattern: str) -> Column:
    """Whether a stripped line matches a pattern for at most so many characters; long lines are told by their length."""
    return F.when(F.length(s) <= most, s.rlike(pattern)).otherwise(F.when(s.isNotNull(), F.lit(False)))


def is_page_number(line: Column) -> Column:
    return stripped_number(strip(line))


def stripped_number(s: Column) -> Column:
    return _matches_short(s, 4, PAGE_NUMBER)


def is_edge_garbage(line: Column) -> Column:
    return stripped_garbage(strip(line))


def stripped_garbage(s: Column) -> Column:
    return _matches_short(s, 1, EDGE_GARBAGE)


def is_garbage_line(line: Column) -> Column:
    return line.rlike(GARBAGE_LINE)


def without_trailing_number(line: Column) -> Column:
    """The stripped line without a page number at its end."""
    s = strip(line)
    return F.when(s.rlike(TRAILING_NUMBER), F.regexp_extract(s, TRAILING_NUMBER, 1)).otherwise(s)


def nonblank(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def printed_number(page: Column) -> Column:
    """The page number printed alone in the last line, or null."""
    full = strip(page)
    last = strip(F.element_at(split_lines(full), -1))
    return F.when(full.rlike(r"\p{Nd}\z"), F.when(stripped_number(last), last))


def noise_score(page: Column) -> Column:
    """Signs of overlapping scans; the lower, the cleaner."""
    return count(page, r"\|") * 3 + count(page, "[a-zà-ÿ][A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]") * 2 + count(page, rf"(?md)^{S}*\p{{Nd}}{{1,4}}{S}+[a-zà-ÿ]") * 4 + count(page, "[—-]*<[-—<>]+") * 5


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Characters that composition may touch; texts without them are composed already.
DECOMPOSED = r"[^\x{0}-\x{2ff}\x{2002}-\x{2125}\x{212c}-\x{2adb}]"


def composed(c: Column) -> Column:
    return F.coalesce(_composed(F.when(c.rlike(DECOMPOSED), c)), c)


@F.pandas_udf(ArrayType(IntegerType()))
def _repeated(pages: pd.Series, folded: pd.Series, numbers: pd.Series, noise: pd.Series) -> pd.Series:
    """Positions of the pages that repeat the cleanest page of the same printed number."""

    def one(own, fold_, num, score) -> list[int] | None:
        if own is None:
            return None
        groups: dict[str, list[int]] = {}
        for i, n in enumerate(num):
            if n is not None:
                groups.setdefault(n, []).append(i)
        out = []
        for same in groups.values():
            if len(same) > 1:
                best = min(same, key=lambda i: (score[i], -len(own[i]), i))
                out += [i for i in same if i != best and _similar(fold_[best], fold_[i])]
        return sorted(out)

    return pd.Series([one(*r) for r in zip(pages, folded, numbers, noise)], dtype="object")


def _similar(a: str, b: str) -> bool:
    """Whether two texts are alike; bounds by length and by common letters spare the comparison where they can."""
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= SIMILAR and m.quick_ratio() >= SIMILAR and m.ratio() >= SIMILAR


def repeated_pages(pages: Column) -> Column:
    """Positions, from 0, of repeated scans; only documents in which a number is printed twice are compared."""
    numbers = F.transform(pages, printed_number)
    known = F.filter(numbers, lambda n: n.isNotNull())
    twice = F.size(known) > F.size(F.array_distinct(known))
    only = lambda c: F.when(twice, c)
    found = _repeated(only(pages), only(F.transform(pages, fold)), only(numbers), only(F.transform(pages, noise_score)))
    return F.coalesce(found, F.array().cast("array<int>"))


def in_order(folds: Column) -> Column:
    return F.array_sort(F.filter(folds, lambda f: f != ""))


def repeated_folds(sorted_folds: Column) -> Column:
    """Values that occur at least twice in a bound, sorted array."""
    return F.array_distinct(F.filter(sorted_folds, lambda f, i: (i > 0) & (f == F.get(sorted_folds, i - 1))))


def first_folds(pages: Column) -> Column:
    """Folded first lines of the pages that have any."""
    return F.filter(F.transform(pages, lambda p: fold(F.regexp_extract(p, rf"\A{S}*([^{NL}]*)", 1))), lambda f: f != "")


def edge_folds(pages: Column) -> Column:
    """Folded first and last lines without page numbers; a lone line counts as both."""

    def bare(line: Column) -> Column:
        s = without_trailing_number(line)
        return fold(F.when(s.rlike(LEADING_NUMBER), F.regexp_extract(s, LEADING_NUMBER, 2)).otherwise(s))

    edges = F.transform(pages, lambda p: nonblank(split_lines(p)))
    full = F.filter(edges, lambda x: F.size(x) > 0)
    return F.concat(F.transform(full, lambda x: bare(F.get(x, F.lit(0)))), F.transform(full, lambda x: bare(F.element_at(x, -1))))


def is_header(line: Column, headers: Column, enhanced: bool = False) -> Column:
    """Whether a line, with or without the page number before it, is a running header."""
    return stripped_header(strip(line), headers, enhanced)


def stripped_header(s: Column, headers: Column, enhanced: bool = False) -> Column:
    hit = F.array_contains(headers, fold(s)) | (s.rlike(LEADING_NUMBER) & F.array_contains(headers, fold(F.regexp_extract(s, LEADING_NUMBER, 2))))
    if enhanced:
        hit = hit | (s.rlike(TRAILING_NUMBER) & F.array_contains(headers, fold(F.regexp_extract(s, TRAILING_NUMBER, 1))))
    return (F.size(headers) > 0) & (s != "") & hit


def _headers(pages: Column, enhanced: bool) -> Column:
    heads = let(in_order(first_folds(pages)), repeated_folds)
    return F.array_union(heads, let(in_order(edge_folds(pages)), repeated_folds)) if enhanced else heads


def _page(lines: Column, heads: Column, enhanced: bool) -> Column:
    """Text of a page without its edges, and what was taken: (text, headers, numbers, garbage)."""
    no = F.lit(False)
    bare = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), strip(x).alias("s"))), lambda x: x["s"] != "")
    flagged = lambda x: F.struct(x["i"].alias("i"), stripped_header(x["s"], heads, enhanced).alias("h"), stripped_number(x["s"]).alias("n"), stripped_garbage(x["s"]).alias("g"), (F.length(x["s"]) <= 3).alias("short"))
    tally = lambda rows, cond: F.size(F.filter(rows, cond))

    def with_rows(nb: Column) -> Column:
        stays = F.transform(nb, lambda x, j: ~(x["h"] | (x["short"] & F.coalesce(F.get(nb, j + 1)["h"], no))))
        return let(leading(stays, nb), lambda top: let(F.slice(nb, top + 1, F.size(nb)), lambda rest: with_top(F.slice(nb, 1, top), rest)))

    def with_top(top: Column, rest: Column) -> Column:
        ends = F.reverse(F.transform(rest, lambda x: ~(x["n"] | x["g"] | (x["h"] if enhanced else no))))
        return let(leading(ends, rest), lambda k: let(F.slice(rest, 1, F.size(rest) - k), lambda body: finished(top, body, F.slice(rest, F.size(rest) - k + 1, F.size(rest)))))

    def finished(top: Column, body: Column, foot: Column) -> Column:
        first, last = F.get(body, F.lit(0))["i"], F.element_at(body, -1)["i"]
        text = F.when(F.size(body) > 0, strip(join(F.slice(lines, first + 1, last - first + 1), "\n"))).otherwise("")
        heads_gone = tally(top, lambda x: x["h"]) + (tally(foot, lambda x: x["h"] & ~x["n"] & ~x["g"]) if enhanced else F.lit(0))
        return F.struct(text.alias("text"), heads_gone.alias("headers"), tally(foot, lambda x: x["n"]).alias("numbers"), (tally(top, lambda x: ~x["h"]) + tally(foot, lambda x: x["g"] & ~x["n"])).alias("garbage"))

    return let(F.transform(bare, flagged), with_rows)


def leading(stays: Column, rows: Column) -> Column:
    """How many rows lie before the first that stays."""
    return F.coalesce(F.nullif(first_index(stays), F.lit(0)) - 1, F.size(rows)).cast("int")


def _chrome(text: Column, pages: Column, gone: Column, enhanced: bool) -> Column:
    """Step 4: (text, headers, numbers, garbage) without page numbers, running headers, edge garbage and repeated scans."""
    total = lambda rows, name: F.aggregate(rows, F.lit(0), lambda a, r: a + r[name])

    def with_heads(own: Column, heads: Column) -> Column:
        page_lines = lambda p: F.filter(F.transform(split_lines(p), rstrip), lambda x: ~is_garbage_line(x))
        done = F.transform(own, lambda p: let(page_lines(p), lambda ls: _page(ls, heads, enhanced)))
        return let(done, lambda d: residual(d, heads))

    def residual(done: Column, heads: Column) -> Column:
        texts = F.filter(F.transform(done, lambda x: x["text"]), lambda p: p != "")
        pairs = F.transform(split_lines(join(texts, "\n")), lambda x: F.struct(x.alias("x"), strip(x).alias("s")))
        flags = F.transform(pairs, lambda x: F.struct(x["x"].alias("x"), stripped_header(x["s"], heads, enhanced).alias("h"), stripped_number(x["s"]).alias("n")))
        left = lambda rows: F.struct(
            join(F.transform(F.filter(rows, lambda x: ~(x["h"] | x["n"])), lambda x: x["x"]), "\n").alias("text"), (total(done, "headers") + F.size(F.filter(rows, lambda x: x["h"]))).alias("headers"),
            (total(done, "numbers") + F.size(F.filter(rows, lambda x: x["n"] & ~x["h"]))).alias("numbers"), total(done, "garbage").alias("garbage"),
        )
        return let(flags, left)

    kept = F.filter(pages, lambda p, i: ~F.array_contains(gone, i))
    paged = let(kept, lambda own: let(_headers(own, enhanced), lambda heads: with_heads(own, heads)))
    plain = let(split_lines(text), lambda ls: let(F.filter(ls, lambda x: ~is_page_number(x)), lambda k: F.struct(join(k, "\n").alias("text"), F.lit(0).alias("headers"), (F.size(ls) - F.size(k)).alias("numbers"), F.lit(0).alias("garbage"))))
    return F.when(pages.isNull(), plain).otherwise(paged)


def strip_invisibles(c: Column) -> Column:
    return F.regexp_replace(c, f"[{INVISIBLE}]", "")


def without_inline_numbers(kept: Column) -> Column:
    """Bound lines, free of garbage lines, without page numbers that open the rest of a hyphenated word."""
    opens = lambda x, i: x.rlike(INLINE_NUMBER) & (i > 0) & F.coalesce(rstrip(F.get(kept, i - 1)).endswith("-"), F.lit(False))
    return F.transform(kept, lambda x, i: F.when(opens(x, i), F.regexp_replace(x, INLINE_NUMBER, "")).otherwise(x))


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, LINE_HYPHEN, "$1$2")


def protect_toc_lines(c: Column) -> Column:
    return join(F.transform(split_lines(c), lambda x: F.when(F.when(F.length(strip(x)) <= 90, strip(x).rlike(TOC_LINE)).otherwise(F.lit(False)), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x)), "\n")


def reflow(c: Column) -> Column:
    paragraphs = F.transform(F.split(c, "\n\n"), lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""))
    return F.concat(join(F.transform(F.filter(paragraphs, lambda p: F.size(p) > 0), lambda p: join(p, " ")), "\n\n"), F.lit("\n"))


def normalize_whitespace(c: Column) -> Column:
    # runs become one space first, so that single spaces beside line ends are all that is left
    c = F.regexp_replace(c, "[ \t]{2,}|\t", " ")
    c = F.replace(F.replace(c, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.concat(strip(F.regexp_replace(c, "\n{3,}", "\n\n")), F.lit("\n"))


def _after_chrome(text: Column, reflow_paragraphs: bool, enhanced: bool) -> Column:
    """Steps 5 to 10 on the text that is left: (text, counters)."""
    whole = F.replace(text, F.lit("\x02\n"), F.lit("")) if enhanced else text

    def with_lines(t5: Column, t6: Column, hidden: Column, all_lines: Column, kept: Column) -> Column:
        return let(without_inline_numbers(kept), lambda shown: let(join(shown, "\n"), lambda joined: finished(t5, t6, hidden, all_lines, kept, shown, joined)))

    def finished(t5: Column, t6: Column, hidden: Column, all_lines: Column, kept: Column, shown: Column, joined: Column) -> Column:
        t8 = protect_toc_lines(dehyphenate(joined)) if enhanced else dehyphenate(joined)
        out = normalize_whitespace(reflow(t8) if reflow_paragraphs else t8)
        inline = F.aggregate(F.zip_with(shown, kept, lambda a, b: (F.length(a) < F.length(b)).cast("int")), F.lit(0), lambda a, x: a + x)
        return F.struct(
            out.alias("text"), hidden.alias("invisible_removed"), count(t5, ISOLATED_BAR).alias("isolated_bars_removed"), count(t6, EMBEDDED_SECTION).alias("embedded_sections_split"), inline.alias("inline_page_numbers_removed"),
            (F.size(all_lines) - F.size(kept)).alias("garbage_lines_removed"), count(joined, LINE_HYPHEN).alias("hyphenations_joined"),
        )

    def with_text(t4: Column, t5: Column) -> Column:
        hidden = F.length(t4) - F.length(t5)
        lines = lambda t6: split_lines(F.regexp_replace(t6, EMBEDDED_SECTION, "\n\n"))
        kept = lambda ls: F.filter(ls, lambda x: ~is_garbage_line(x))
        return let(F.regexp_replace(t5, ISOLATED_BAR, ""), lambda t6: let(lines(t6), lambda ls: let(kept(ls), lambda k: with_lines(t5, t6, hidden, ls, k))))

    return let(whole, lambda t4: let(strip_invisibles(t4), lambda t5: with_text(t4, t5)))


def clean_text(df: DataFrame, text_col: str, *, reflow_paragraphs: bool = True, drop_leading_pages: int = 0, enhanced: bool = False, prefix: str = "clean_") -> DataFrame:
    """All steps, in their order; see the module for what is added."""
    if drop_leading_pages < 0:
        raise ValueError("drop_leading_pages must not be negative")
    raw, own = F.col(text_col), "__pal_"
    t2, t3, pages, gone, done = (F.col(own + x) for x in ("t2", "t3", "pages", "gone", "done"))
    every = F.split(t3, "\f")
    rest = let(every, lambda p: F.slice(p, drop_leading_pages + 1, F.greatest(F.size(p) - drop_leading_pages, F.lit(0)))) if drop_leading_pages else every
    df = df.withColumn(own + "t2", composed(straight_quotes(raw))).withColumn(own + "t3", F.regexp_replace(t2, PAGE_MARKER, ""))
    df = df.withColumn(own + "pages", F.when(F.contains(t3, F.lit("\f")), rest)).withColumn(own + "gone", repeated_pages(pages))

    def result(chrome: Column) -> Column:
        return let(_after_chrome(chrome["text"], reflow_paragraphs, enhanced), lambda after: with_counts(chrome, after))

    def with_counts(chrome: Column, after: Column) -> Column:
        paged, n = pages.isNotNull(), F.size(every)
        lost = count(after["text"], r"\x{fffd}")
        values = {
            "chars_in": F.length(raw), "chars_out": F.length(after["text"]), "page_markers_removed": count(t2, PAGE_MARKER), "headers_removed": chrome["headers"], "page_numbers_removed": chrome["numbers"], "edge_garbage_removed": chrome["garbage"],
            "pages_processed": F.when(paged, n).otherwise(0), "leading_pages_dropped": F.when(paged, F.least(n, F.lit(drop_leading_pages))).otherwise(0), "duplicate_pages_removed": F.when(paged, F.size(gone)).otherwise(0), "replacement_chars": lost,
        }
        stats = F.struct(*((values[k] if k in values else after[k]).cast("bigint").alias(k) for k in STATS))
        warning = F.concat(lost.cast("string"), F.lit(" caractere(s) de substituição (\ufffd) — revisar OCR"))
        return F.struct(after["text"].alias("text"), stats.alias("stats"), F.when(lost > 0, F.array(warning)).otherwise(F.array().cast("array<string>")).alias("warnings"))

    df = df.withColumn(own + "done", F.when(raw.isNotNull(), let(_chrome(t3, pages, gone, enhanced), result)))
    return df.withColumns({f"{prefix}{k}": done[k] for k in ("text", "stats", "warnings")}).drop(*(own + x for x in ("t2", "t3", "pages", "gone", "done")))
