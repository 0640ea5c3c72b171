from __future__ import annotations

import random

import pytest

from palimpsest.operators.structure import apply_structure

LONG = "Prosa longa sobre a história. " * 6


def structured(spark, texts, enhanced=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r for r in apply_structure(df, "t", enhanced=enhanced).orderBy("id").collect()]


def test_rules(spark):
    cases = [
        ("3. Os avanços técnicos", "## 3. Os avanços técnicos\n"), ("1.2 Sub", "### 1.2 Sub\n"), ("1.2.3 Detalhe", "#### 1.2.3 Detalhe\n"), ("1. 2773", "1. 2773\n"), ("AS PRIMEIRAS CIVILIZAÇÕES", "# AS PRIMEIRAS CIVILIZAÇÕES\n"),
        ("DEPÓSITO LEGAL 123456", "DEPÓSITO LEGAL 123456\n"), ("Preâmbulo", "# Preâmbulo\n"), ("IL - OS MUNDOS ANTIGOS", "# II. — OS MUNDOS ANTIGOS\n"), (f"{LONG}\n\nUm Título Curto\n\n{LONG}", f"{LONG.strip()}\n\n## Um Título Curto\n\n{LONG.strip()}\n"),
        (f"SUMÁRIO\n\nUm .... 3\n\nDois .... 9\n\n{LONG}", f"# SUMÁRIO\n\n- Um .... 3\n\n- Dois .... 9\n\n{LONG.strip()}\n"), ("", ""), ("12.5 milhões de pessoas", "### 12.5 milhões de pessoas\n"),
    ]
    for row, (text, want) in zip(structured(spark, [c[0] for c in cases]), cases):
        assert row.structured_text == want, text


def test_enhanced(spark):
    rows = structured(spark, ["4. Wilamowitz, op. cit., p. 178.", "• item", "Cap um\n\n.... 44", "A, 1\n\nB, 2\n\nC, 3"], True)
    assert [r.structured_text for r in rows] == ["4. Wilamowitz, op. cit., p. 178.\n", "- item\n", "Cap um .... 44\n", "- A, 1\n\n- B, 2\n\n- C, 3\n"]


def test_null_and_long(spark):
    rows = structured(spark, [None, ". " * 60_000, "\n\n".join(["A, 1"] * 5000)], True)
    assert rows[0].structured_text is None and rows[0].structured_stats is None and rows[2].structured_stats.toc_entries == 5000


#: Paragraphs with what becomes of them outside a table of contents, in plain mode: (text, kind, rendered).
KNOWN = [
    ("1. Nova seção", "h2", "## 1. Nova seção"), ("1.2 Sub", "h3", "### 1.2 Sub"), ("12.5 milhões", "h3", "### 12.5 milhões"), ("Preâmbulo", "h1", "# Preâmbulo"), ("A ORIGEM DAS COISAS", "h1", "# A ORIGEM DAS COISAS"),
    ("ISBN 978 COPYRIGHT", "prose", "ISBN 978 COPYRIGHT"), ("IL - OS MUNDOS", "h1", "# II. — OS MUNDOS"), ("Outro título.", "prose", "Outro título."), ("x" * 130, "prose", "x" * 130), (LONG, "prose", LONG.strip()), ("# já marcado", "prose", "# já marcado"),
    ("Nota com 3 dígitos", "prose", "Nota com 3 dígitos"), ("1. 2773", "prose", "1. 2773"), ("linha, fim.", "prose", "linha, fim."),
]


@pytest.mark.parametrize("enhanced", [False, True])
def test_any_mix_of_known_paragraphs(spark, enhanced):
    r = random.Random(1)
    picks = [[r.choice(KNOWN) for _ in range(r.randint(0, 14))] for _ in range(300)]
    for row, own in zip(structured(spark, ["\n\n".join(p[0] for p in x) for x in picks], enhanced), picks):
        assert row.structured_text == "\n\n".join(p[2] for p in own) + ("\n" if own else "")
        stats = row.structured_stats.asDict()
        assert {k: stats[k] for k in ("h1", "h2", "h3", "h4", "prose", "toc_entries")} == {k: sum(p[1] == k for p in own) for k in ("h1", "h2", "h3", "h4", "prose", "toc_entries")}
        assert stats["heading_ocr_corrections"] == sum(p[0].startswith("IL") for p in own)


@pytest.mark.parametrize("enhanced", [False, True])
def test_contents_end_at_the_first_long_paragraph(spark, enhanced):
    r = random.Random(2)
    entries = [[f"Parte {w} .... {k}" for k, w in enumerate(r.sample(["um", "dois", "três", "quatro"], r.randint(1, 4)))] for _ in range(40)]
    texts = ["\n\n".join(["Antes.", "ÍNDICE GERAL", *e, LONG, "Depois, 31"]) for e in entries]
    for row, e in zip(structured(spark, texts, enhanced), entries):
        assert row.structured_text.split("\n\n") == ["Antes.", "# ÍNDICE GERAL", *(f"- {x}" for x in e), LONG.strip(), "Depois, 31\n"]
        assert row.structured_stats.toc_entries == len(e) and row.structured_stats.prose == 3


def test_counters_sum_to_paragraphs(spark):
    r = random.Random(5)
    bits = [*(k[0] for k in KNOWN), "SUMÁRIO", "Título um .... 12", "Capítulo dois, 31", ".... 44", ", 312", "4. Nota, op. cit.", "• item um", "*", "Um Título Curto", "   "]
    texts = ["\n\n".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(300)]
    for enhanced in (False, True):
        for row, t in zip(structured(spark, texts, enhanced), texts):
            s, n = row.structured_stats, len([p for p in row.structured_text.split("\n\n") if p.strip()])
            assert s.h1 + s.h2 + s.h3 + s.h4 + s.toc_entries + s.prose + s.list_items == n and s.title_case_headings <= s.h2
            assert enhanced or n == len([p for p in t.split("\n\n") if p.strip()])
