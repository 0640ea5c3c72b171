from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.strings import fold, split_lines, strip
from palimpsest.operators import cleanup


def cleaned(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r for r in cleanup.clean_text(df, "t", **how).orderBy("id").collect()]


CASES = {
    "hyphen": ("o conheci-\nmento humano", "conhecimento", {"hyphenations_joined": 1}),
    "invisible": ("pala​vra﻿ final", "palavra final", {"invisible_removed": 2}),
    "marker": ("linha um\n-- 3 of 578 --\nlinha dois", "linha um\n\nlinha dois", {"page_markers_removed": 1}),
    "number line": ("texto um\n42\ntexto dois", "texto um texto dois", {"page_numbers_removed": 1, "pages_processed": 0}),
    "headers": ("PREAMBULO\nUm texto.\n22\fPREÂMBULO\nOutro texto.\n\"\n23", "Um texto. Outro texto.", {"headers_removed": 2, "page_numbers_removed": 2, "edge_garbage_removed": 1}),
    "glued header": ("As PRIMEIRAS\num\f23 As PRIMEIRAS\ndois\fAs PRIMEIRAS\ntrês", "um dois três", {"headers_removed": 3}),
    "short before header": ("TÍTULO A\num\fTÍTULO A\ndois\fdá\nTÍTULO A\ntrês", "um dois três", {"edge_garbage_removed": 1, "headers_removed": 3}),
    "after hyphen": ("período imen-\n10 de todos os grupos", "imende todos", {"inline_page_numbers_removed": 1}),
    "section": ("Fim da análise. 4. Nova seção aqui", "Fim da análise.\n\n4. Nova seção", {"embedded_sections_split": 1}),
    "bars": ("um | dois\n—<——\ntrês", "um dois três", {"isolated_bars_removed": 1, "garbage_lines_removed": 1}),
    "lost": ("a � b", "a � b", {"replacement_chars": 1}),
    "quotes": ("“a” ‘b’", "\"a\" 'b'", {}),
}


def test_rules(spark):
    rows = cleaned(spark, [c[0] for c in CASES.values()])
    for row, (name, (_, text, stats)) in zip(rows, CASES.items()):
        assert text in row.clean_text, name
        for k, v in stats.items():
            assert row.clean_stats[k] == v, (name, k)
    assert rows[list(CASES).index("lost")].clean_warnings[0].startswith("1 ")


def test_repeated_scans_and_leading_pages(spark):
    clean, noisy = "A primeira página traz um texto longo e bom\n14", "A primeira | página traz um texto longo e bom\n14"
    row = cleaned(spark, [f"{noisy}\f{clean}"])[0]
    assert row.clean_stats.duplicate_pages_removed == 1 and "|" not in row.clean_text
    row = cleaned(spark, ["CAPA\fFICHA\fCorpo do livro"], drop_leading_pages=2)[0]
    assert row.clean_text == "Corpo do livro\n" and row.clean_stats.leading_pages_dropped == 2
    with pytest.raises(ValueError):
        cleaned(spark, ["x"], drop_leading_pages=-1)


def test_enhanced(spark):
    text = "Um corpo\nLUGAR DOS GREGOS 17\fOutro corpo\nLUGAR DOS GREGOS 18"
    assert "GREGOS" not in cleaned(spark, [text], enhanced=True)[0].clean_text
    assert "GREGOS" in cleaned(spark, [text])[0].clean_text


def test_edges(spark):
    rows = cleaned(spark, [None, "", "\f", "x" * 300_000, "a-\nb-\nc"])
    assert rows[0].clean_text is None and rows[0].clean_stats is None
    assert rows[1].clean_text == "\n" and rows[2].clean_text == "\n" and len(rows[3].clean_text) == 300_001
    assert rows[4].clean_text == "ab- c\n"
    assert cleanup.clean_text(spark.createDataFrame([], "id int, t string"), "t").count() == 0
    clash = spark.createDataFrame([("x", "kept", "p")], "t string, text string, pages string")
    assert cleanup.clean_text(clash, "t").first().text == "kept"


WORDS = "casa rio monte pedra ponte livro terra vento folha campo noite manhã irmão cabeça história água".split()


def book(r, n_pages, enhanced=False):
    """A book of clean lines and the same book with planted dirt; what was planted, by counter."""
    planted = dict.fromkeys(["headers_removed", "page_numbers_removed", "edge_garbage_removed", "garbage_lines_removed", "isolated_bars_removed", "hyphenations_joined", "page_markers_removed", "invisible_removed"], 0)
    title, clean, dirty = "O Livro Das Terras", [], []
    for n in range(n_pages):
        words = [r.choice(WORDS) for _ in range(r.randint(12, 40))]
        clean += words
        lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
        whole = lines[-1].split()
        if len(whole) > 1 and r.random() < 0.5:  # a word broken at a line end
            w = whole[-1]
            lines[-1:] = [" ".join(whole[:-1] + [w[:2] + "-"]), w[2:]]
            planted["hyphenations_joined"] += 1
        if r.random() < 0.4:
            lines.insert(1, "—<—")  # goes with its page's edges, uncounted
        if r.random() < 0.4:
            lines[0] += " | "
            planted["isolated_bars_removed"] += 1
        if r.random() < 0.4:
            lines[0] = lines[0][:1] + "\u200b" + lines[0][1:]
            planted["invisible_removed"] += 1
        marked = r.random() < 0.4
        if marked:  # leaves an empty line, so it stands below the header
            lines.insert(0, "-- 3 of 9 --")
            planted["page_markers_removed"] += 1
        head = r.choice([title, title.upper(), f"{10 + n} {title}", f"  {title}  "])
        planted["headers_removed"] += 1
        lines.insert(0, title if n < 2 else head)  # at least two pages begin with the plain title
        if enhanced and r.random() < 0.5:
            lines.append(f"{title} {30 + n}")
            planted["headers_removed"] += 1
        if r.random() < 0.5:
            lines.append('"')
            planted["edge_garbage_removed"] += 1
        if r.random() < 0.7:
            lines.append(str(100 + n))
            planted["page_numbers_removed"] += 1
        dirty.append(("\n" if marked else r.choice(["\n", "\r\n", "\u2028"])).join(lines))
    return " ".join(clean), "\f".join(dirty), planted


@pytest.mark.parametrize("enhanced", [False, True])
def test_planted_dirt_goes_and_all_else_stays(spark, enhanced):
    r = random.Random(3)
    books = [book(r, r.randint(2, 6), enhanced) for _ in range(60)]
    for row, (clean, dirty, planted) in zip(cleaned(spark, [b[1] for b in books], enhanced=enhanced), books):
        stats = row.clean_stats.asDict()
        assert row.clean_text == clean + "\n", dirty
        assert {k: stats[k] for k in planted} == planted and stats["pages_processed"] == dirty.count("\f") + 1
        assert (stats["chars_in"], stats["chars_out"]) == (len(dirty), len(row.clean_text))


def test_properties_of_any_text(spark):
    r = random.Random(4)
    bits = ["Título Um", "TITULO UM", "12 Título Um", "palavra-", "resto 1914", "\f", "\f", "\n", "\n\n", "42", "9", "—<—", "|", "a | b", "dá", ".", "\xa0", "", "\u200b", "1. Nova", "Fim. 2. Outra", "-- 1 of 9 --", "cap ..... 7", "e\u0301", "\x02", "10 de novo", "\r\n", "\x1c"]
    texts = ["\n".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(300)]
    first = cleaned(spark, texts)
    again = cleaned(spark, [row.clean_text for row in first])
    for t, row, twice in zip(texts, first, again):
        out, s = row.clean_text, row.clean_stats
        assert out.endswith("\n") and "\f" not in out and "\u200b" not in out and "  " not in out and "\n\n\n" not in out and unicodedata.is_normalized("NFC", out)
        assert all(v >= 0 for v in s.asDict().values()) and s.chars_in == len(t) and s.chars_out == len(out)
        assert s.pages_processed <= t.count("\f") + 1 and s.leading_pages_dropped == 0  # a marker takes the white space around it, page ends too
        assert [x for x in out.split("\n") if x.strip().isdigit() and len(x.strip()) <= 4] == [] or s.embedded_sections_split
        assert len("".join(twice.clean_text.split())) <= len("".join(out.split())) and twice.clean_stats.invisible_removed == 0


def test_string_semantics(spark):
    texts = ["\x1c a b\x85", "a\r\nb\rc", "", "x\n", "ÀÇã ß ﬁ", "ΆΒ", "Straße", "\xa0"]
    folded = ["a b", "a\r\nb\rc", "", "x", "aca ss ﬁ", "αβ", "strasse", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(strip(F.col("t")), split_lines(F.col("t")), fold(F.col("t"))).collect()
    assert [list(row) for row in got] == [[t.strip(), t.splitlines(), f] for t, f in zip(texts, folded)]
