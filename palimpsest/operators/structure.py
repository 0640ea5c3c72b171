"""Markdown structure of cleaned text: headings, table-of-contents entries, lists, prose.

A document's paragraphs are an array; every paragraph is classified by expressions over it, its neighbours
and the state of the table of contents, in closed form: a paragraph lies in a table of
contents if the last entering paragraph before it comes after the last leaving one. No shuffle, no loop
over documents; one row per document comes out.

``enhanced`` merges entries that were split before their page number, enters a table of contents at
three entries in a row, takes typographic bullets for lists and numbered footnotes for prose.
Null text gives null results; empty text gives empty text and zero counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import WS, S, fold, join, let, strip, upper_ratio

# Markers, names and patterns of the structure rules.
TOC_MARKERS = ["sumario", "indice", "conteudo", "table of contents"]
COLOPHON = ["deposito legal", "paginacao", "impressao", "acabamento", "design de capa", "isbn", "copyright", "todos os direitos", "titulo original"]
NAMED = ["preambulo", "introducao", "conclusao", "epilogo", "anexo", "apendice", "bibliografia", "agradecimentos", "nota do autor", "nota do tradutor"]
NUMBERED = rf"\A(?:(\p{{Nd}}+(?:\.\p{{Nd}}+){{1,3}}){S}+|(\p{{Nd}}+)\.{S}+)([^\n]+)\n?\z"
TOC_ENTRY = rf"\A[^\n]+?[.…]{{2,}}{S}*\p{{Nd}}{{1,4}}{S}*\z"
TOC_LIKE = rf"(?:[.…]{S}*[.…][.…{WS}]*+|,){S}*\p{{Nd}}{{1,4}}{S}*;?{S}*\z"
TOC_TAIL = rf"\A(?:[.…]{{2,}}{S}*|,){S}*\p{{Nd}}{{1,4}}{S}*;?{S}*\z"
ROMAN_TWO = rf"\AIL{S}*[.\-–—]{S}*"
BULLET = rf"\A[•●▪‣◦*]{S}*([^{WS}](?s:.*))\z"
SHORT, LONG = 90, 120

STATS = ["h1", "h2", "h3", "h4", "toc_entries", "prose", "title_case_headings", "heading_ocr_corrections", "list_items"]


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def is_toc_marker(folded: Column) -> Column:
    return folded.rlike(r"\A(?:" + "|".join(TOC_MARKERS) + r")(?:\z| )")


def is_colophon(folded: Column) -> Column:
    return folded.rlike("|".join(COLOPHON))


def is_named(folded: Column) -> Column:
    return folded.isin(NAMED)


def is_toc_entry(p: Column) -> Column:
    return p.rlike(rf"(?<=[.…]{{2}}){S}*+\p{{Nd}}{{1,4}}{S}*+\z") & p.rlike(TOC_ENTRY)  # the first part keeps long rows of dots cheap


def is_toc_like(p: Column) -> Column:
    # not an AND, whose parts may be reordered: the pattern is for short lines only
    return F.when(F.length(p) <= SHORT, p.rlike(TOC_LIKE)).otherwise(F.lit(False))


def is_capitals(p: Column, folded: Column) -> Column:
    n = F.length(p)
    return (n >= 8) & (n <= 70) & (upper_ratio(p) >= 0.75) & ~p.endswith(".") & ~F.contains(p, F.lit(";")) & ~is_colophon(folded)


def numbered_level(p: Column) -> Column:
    """Level 2 to 4 of a numbered heading, by the depth of its number; null for other paragraphs."""
    deep = F.regexp_extract(p, NUMBERED, 1)
    fits = p.rlike(NUMBERED) & (F.length(p) <= SHORT) & F.regexp_extract(p, NUMBERED, 3).rlike(r"\p{L}")
    return F.when(fits, F.least(F.length(deep) - F.length(F.replace(deep, F.lit("."), F.lit(""))) + 2, F.lit(4)))


def base_level(p: Column, folded: Column) -> Column:
    """Level outside a table of contents: 1 to 4, or null for prose."""
    return F.when((F.length(p) <= SHORT) & is_named(folded), 1).when(is_capitals(p, folded), 1).otherwise(numbered_level(p))


def title_like(p: Column, folded: Column) -> Column:
    """What a title-case heading must be by itself, without its neighbours."""
    n = F.length(p)
    words = F.size(F.filter(F.split(p, f"{S}+"), lambda w: w != ""))
    return (n >= 8) & (n <= 50) & p.rlike(r"\A\p{Lu}") & ~p.rlike(r"[.!?:;,]\z") & ~p.rlike(r"[\p{Nd}\p{No}&&[^¼-¾]]") & ~is_colophon(folded) & (words >= 2) & (words <= 8)


def fix_roman(p: Column) -> Column:
    return F.regexp_replace(p, ROMAN_TWO, "II. — ")


def _merged(ps: Column) -> Column:
    """Paragraphs, those that lack only their page number joined with the next one."""

    def with_flags(takes: Column) -> Column:
        rows = F.transform(ps, lambda p, i: F.struct(F.when(F.get(takes, i), F.concat(p, F.lit(" "), F.get(ps, i + 1))).otherwise(p).alias("p"), F.coalesce((i > 0) & F.get(takes, i - 1), F.lit(False)).alias("gone")))
        return F.transform(F.filter(rows, lambda x: ~x["gone"]), lambda x: x["p"])

    return let(F.transform(ps, lambda p, i: ~is_toc_like(p) & (F.length(p) <= SHORT) & F.coalesce(F.get(ps, i + 1).rlike(TOC_TAIL), F.lit(False))), with_flags)


def _facts(p: Column, f: Column, enhanced: bool) -> Column:
    """What can be said of a paragraph by itself."""
    no = F.lit(False)
    marker = is_toc_marker(f)
    foot = (lambda level: p.endswith(".") & p.rlike(NUMBERED) & level.isin(2, 3, 4)) if enhanced else (lambda level: no)
    level = let(F.when(marker, 1).otherwise(base_level(p, f)), lambda x: F.when(~F.coalesce(foot(x), no), x))
    return F.struct(
        p.alias("p"), marker.alias("marker"), level.alias("level"), ((F.length(p) <= SHORT) | is_toc_entry(p)).alias("entry"), title_like(p, f).alias("title"),
        (is_toc_like(p) if enhanced else no).alias("like"), (F.when(p.rlike(BULLET), F.regexp_extract(p, BULLET, 1)) if enhanced else F.lit(None).cast("string")).alias("item"),
    )


def _states(xs: Column, triple: Column) -> Column:
    """Before each paragraph and after the last, whether a table of contents is open, as E or X."""
    change = lambda x, i: F.when(x["marker"], "E").when(~x["entry"], "X").when(F.get(triple, i), "E").otherwise(".")
    # E enters, X leaves, a dot keeps; each run of dots takes the letter before it
    runs = F.regexp_extract_all(F.concat(F.lit("X"), join(F.transform(xs, change), "")), F.lit(r"[EX]\.*"), F.lit(0))
    return F.split(join(F.transform(runs, lambda g: F.repeat(F.left(g, F.lit(1)), F.length(g))), ""), "")


def _kinds(xs: Column, triple: Column, states: Column) -> Column:
    def kind(x: Column, i: Column) -> Column:
        is_open = F.get(states, i) == "E"
        inside, bullet = is_open | F.get(triple, i), x["item"].isNotNull() & ~is_open
        level = F.when(x["marker"], 1).when(inside & x["entry"], 0).when(inside, None).otherwise(x["level"])
        return F.struct(x["p"].alias("p"), F.when(bullet, None).otherwise(level).alias("level"), F.when(bullet, x["item"]).alias("item"), (x["title"] & ~bullet & level.isNull() & (F.get(states, i + 1) != "E")).alias("title"))

    return F.transform(xs, kind)


def _blocks(ks: Column) -> Column:
    no = F.lit(False)

    def titled(x: Column, i: Column) -> Column:
        before, after = F.get(ks, i - 1), F.get(ks, i + 1)
        shown = F.when(before["item"].isNotNull(), F.length(before["item"]) + 2 >= LONG).when(before["level"] == 0, F.length(before["p"]) + 2 >= LONG).when(before["level"] > 0, True).otherwise((F.length(before["p"]) >= LONG) | before["p"].startswith("#"))
        # the text that follows is the next paragraph as it stands, whatever it becomes
        return F.coalesce((i > 0) & x["title"] & shown & (F.length(after["p"]) >= LONG), no)

    def rendered(x: Column, title: Column) -> Column:
        def with_level(level: Column) -> Column:
            fixed = F.coalesce((level > 0) & x["p"].rlike(ROMAN_TWO), no)
            name = F.when(x["item"].isNotNull(), "list").when(level == 0, "toc").when(level > 0, F.concat(F.lit("h"), level.cast("string"))).otherwise("prose")
            text = F.when(x["item"].isNotNull(), F.concat(F.lit("- "), x["item"])).when(level == 0, F.concat(F.lit("- "), x["p"])).when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), fix_roman(x["p"]))).otherwise(x["p"])
            return F.struct(x["p"].alias("text"), name.alias("kind"), level.alias("level"), title.alias("title_case"), fixed.alias("fixed"), text.alias("rendered"))

        return let(F.when(title, 2).otherwise(x["level"]), with_level)

    return F.transform(ks, lambda x, i: let(titled(x, i), lambda title: rendered(x, title)))


def structure_blocks(text: Column, *, enhanced: bool = False) -> Column:
    """An array of (text, kind, level, title_case, fixed, rendered), one of each paragraph."""
    no = F.lit(False)

    def with_facts(xs: Column) -> Column:
        three = lambda x, i: x["like"] & x["item"].isNull() & F.coalesce(F.get(xs, i + 1)["like"], no) & F.coalesce(F.get(xs, i + 2)["like"], no)
        triple = F.transform(xs, three) if enhanced else F.transform(xs, lambda x: no)
        return let(triple, lambda t: let(_states(xs, t), lambda s: let(_kinds(xs, t, s), _blocks)))

    folded = lambda ps: F.transform(F.transform(ps, lambda p: F.struct(p.alias("p"), fold(p).alias("f"))), lambda x: _facts(x["p"], x["f"], enhanced))
    return let(paragraphs(text), lambda ps: let(_merged(ps) if enhanced else ps, lambda own: let(folded(own), with_facts)))


def apply_structure(df: DataFrame, text_col: str, *, enhanced: bool = False, prefix: str = "structured_") -> DataFrame:
    """``df`` with ``<prefix>text`` in Markdown and ``<prefix>stats``."""
    blocks = F.col("__pal_blocks")
    tally = lambda cond: F.size(F.filter(blocks, cond)).cast("bigint")
    of_kind = lambda name: tally(lambda b: b["kind"] == name)
    kinds = {"h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "toc_entries": "toc", "prose": "prose", "list_items": "list"}
    values = {k: of_kind(v) for k, v in kinds.items()} | {"title_case_headings": tally(lambda b: b["title_case"]), "heading_ocr_corrections": tally(lambda b: b["fixed"])}
    text = F.when(F.size(blocks) > 0, F.concat(join(F.transform(blocks, lambda b: b["rendered"]), "\n\n"), F.lit("\n"))).otherwise(F.lit(""))
    both = F.when(blocks.isNotNull(), F.struct(text.alias("text"), F.struct(*(values[k].alias(k) for k in STATS)).alias("stats")))
    df = df.withColumn("__pal_blocks", structure_blocks(F.col(text_col), enhanced=enhanced)).withColumn("__pal_both", both)
    return df.withColumn(f"{prefix}text", F.col("__pal_both.text")).withColumn(f"{prefix}stats", F.col("__pal_both.stats")).drop("__pal_blocks", "__pal_both")


def clean_and_structure(df: DataFrame, text_col: str, *, enhanced: bool = False, **how: bool | int) -> DataFrame:
    """Cleanup (``how`` as of ``clean_text``), then structure."""
    from .cleanup import clean_text

    return apply_structure(clean_text(df, text_col, enhanced=enhanced, **how), "clean_text", enhanced=enhanced)
