"""Problems 1, 4 and 5: texts restored, repaired and brought to one form."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import encodings, mojibake, normal_form, scan_noise

WORDS = "próprio caminho religião história avó coração também cidade não está ação república três relação página município ciência século opinião fundação".split()


def corpus(n=400, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(40)) + "." for _ in range(n)]


def broken(text, how):
    if how == "lost":
        return text.replace("ó", "?").replace("ã", "�")
    true, shown = how
    return "".join(encodings_shown(b, shown) for b in text.encode(true))


def encodings_shown(b, name):
    if b < 0x80:
        return chr(b)
    return {v: k for k, v in encodings.high(name).items()}[b]


@pytest.fixture(scope="module")
def repaired(spark):
    good = corpus()
    how = {1: ("utf-8", "cp1252"), 2: ("utf-8", "mac_roman"), 3: ("utf-8", "cp437"), 4: ("cp1252", "cp850"), 5: "lost"}
    rows = [(k, broken(good[k], h)) for k, h in how.items()] + [(k, t) for k, t in enumerate(good) if k > 5]
    rows += [(9001, None), (9002, ""), (9003, "Århild Sjöqvæst vendeu por £ 3 a παιδεία, 2ª edição ½ € 4."), (9004, "É a avó? Não. REVISÃO DO CÓDIGO"), (9005, rows[0][1]), (9006, "ação " * 60_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, t string, text string")
    return good, {r.id: r for r in mojibake.repaired(df, "id", "t").collect()}


def test_mojibake_restores(repaired):
    good, got = repaired
    for k in (1, 2, 3, 4):
        assert got[k].text == good[k] and got[k].restored and got[k].mappings, k
    assert got[5].lost and got[9005].text == got[1].text


def test_mojibake_leaves_good_text(repaired):
    good, got = repaired
    assert not [k for k in range(6, 400) if got[k].restored or got[k].lost or got[k].text != good[k]]
    for k in (9002, 9003, 9004, 9006):
        assert (got[k].restored, got[k].lost) == (0, 0), k
    assert got[9001].text is None and got[9002].text == ""


def test_mojibake_empty_table(spark):
    assert mojibake.repaired(spark.createDataFrame([], "id bigint, t string"), "id", "t").count() == 0


def test_normal_form():
    cases = {
        "Ｃｅｒｔａ １２": "Certa 12", "pacíﬁca": "pacífica", "ação": "ação", "a​b": "ab", "a b": "a b", "Mаіѕ": "Mais", "книга": "книга", "λόγος": "λόγος", "1ª ½ “x” — …": "1ª ½ “x” — …", "Ã  vez": "Ã  vez",
        "co­isa": "coisa", "a‍́": "á", "": "", "x　y": "x y",
    }
    for text, want in cases.items():
        assert normal_form.normalize(text)[0] == want, text
        assert normal_form.normalize(want)[0] == want
        assert sum(normal_form.normalize(text)[1].values()) == 0 if text == want else sum(normal_form.normalize(text)[1].values()) > 0
    assert normal_form.normalize("é" * 200_000)[0] == "é" * 200_000


def test_normal_form_quick_check(spark):
    chars = [chr(p) for p in (*range(0x80, 0x3200), 0xFB01, 0xFEFF, 0xFF21, 0x1D400) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(c, c) for c in chars] + [(None, "k")], "t string, text string")
    flagged = {r.t for r in df.filter(normal_form.is_unstable(F.col("t"))).collect()}
    assert [c for c in chars if normal_form._unstable().search(c) and c not in flagged] == []
    assert all(unicodedata.is_normalized("NFC", c) for c in chars if c not in flagged)
    got = {r.t: r for r in normal_form.normalized(df, "t").collect()}
    assert got[None].nf_text is None and got[None].text == "k"


def prose(n=3000, seed=2):
    r = random.Random(seed)
    words = "certo mesmo qualquer antigo caminho história cidade mosteiro crônica fundação pequeno governo tradição dinheiro segundo conselho".split()
    return [" ".join(r.choice(words) for _ in range(30)).capitalize() + "." for _ in range(n // 30)]


@pytest.fixture(scope="module")
def noise(spark):
    noisy = {
        1: "O ccrto caminho antigo.", 2: "O mesmo mostei-\nro antigo.", 3: "O rnesmo conselho.", 4: "ANAIS DA CIDADE 12\nO mesmo conselho antigo.\fANAIS DA CIDADE 14\nO governo.", 5: "Fim do conselho.\n— 57 —", 6: "O gover- no antigo.", 7: "O qua1quer caminho.",
        8: "O mesmo 22 O CABIDO ANTIGO caminho.", 9: "Página 12\nO mesmo conselho.",
    }
    clean = {21: "O mesmo\ncaminho antigo em 1684.", 22: "O caminho do ano\n1684.", 23: "Um mestre bem-vindo — disse — e o governo.", 24: "O CONSELHO DA CIDADE FUNDOU O MOSTEIRO ANTIGO.", 25: "", 26: None, 27: "Xotelfasal e Deninnhe.", 28: "|", 29: "conselho " * 40_000}
    rows = [*noisy.items(), *clean.items(), *((1000 + i, t) for i, t in enumerate(prose())), (31, noisy[1])]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "k bigint, t string, joined int")
    return noisy, clean, df


def test_scan_noise(spark, noise):
    noisy, clean, df = noise
    got = {r.k: r for r in scan_noise.repaired(df, ["k"], "t").collect()}
    assert [k for k in (*noisy, 31) if not any(got[k][c] for c in scan_noise.COUNTS)] == []
    assert [k for k in clean if any(got[k][c] for c in scan_noise.COUNTS)] == []
    assert got[1].text == "O certo caminho antigo." and got[2].text == "O mesmo mosteiro antigo." and got[3].text == "O mesmo conselho."
    assert got[4].text == "O mesmo conselho antigo. O governo." and got[6].text == "O governo antigo." and got[8].text == "O mesmo caminho."
    assert got[26].text is None and got[25].text == ""
    assert {r.k for r in scan_noise.repaired(df, ["k"], "t", noisy_only=True).collect()} == {*noisy, 31}


def test_scan_noise_misread_numbers():
    tool = scan_noise.Repairer({}, None)
    for text in ("prosa HISTORIA l99 prosa", "prosa 9O HISTORIA prosa", "prosa HISTORIA., 99 prosa"):
        assert tool.repair(text) == ("prosa prosa", 0, 0, 1, 0), text
    for text in ("prosa [l3] prosa", "prosa — S3 — prosa", "prosa--  l2 of 3O --  prosa"):
        assert tool.repair(text) == ("prosa prosa", 0, 0, 0, 1), text


def test_scan_noise_neighbours_of_many_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abdegmnoprstuv") for _ in range(9)) for _ in range(1500)]
    text = [[r.choice(words) for _ in range(200_000)] for _ in range(4)]  # about 670,000 distinct pairs
    seen = {p for t in text for p in zip(t, t[1:])}
    counts = scan_noise.pair_counts(spark.createDataFrame([(" ".join(t),) for t in text], "t string"), "t").collect()
    tool = scan_noise.Repairer({}, {r.hash & scan_noise._FULL: r.n for r in counts})
    some = [(r.choice(words), r.choice(words), r.choice(words)) for _ in range(1000)]
    unseen = [x for x in some if not seen & {x[:2], x[1:]}]
    assert len(unseen) > 100 and not any(tool.beside(*x) for x in unseen)
    assert all(tool.beside(*x) for x in some if seen & {x[:2], x[1:]})


def test_scan_noise_headers_come_back(spark):
    page = "certo caminho antigo da cidade.\nMesmo governo."
    rows = [
        (1, "b", f"A CASA DO RIO\n{page}\fA CASA D0 RIO\n{page}"), (2, "b", f"O COMEÇO\n{page}"), (3, "c", f"A CASA DO RIO\n{page}"), (4, None, f"A PONTE\n{page}\fA PONTE\n{page}"),
        (5, None, f"O MOINHO\n{page}"), (6, None, f"O MOINHO\n{page}"), (7, "c", f"O FIM 31\n{page}"), (8, "d", f"Capítulo 2\n{page}\fCapítulo 3\n{page}"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k bigint, b string, t string, book string")
    got = {r.k: r for r in scan_noise.repaired(df, ["k"], "t", "b").collect()}
    assert {k: r.headers for k, r in got.items()} == {1: 2, 2: 0, 3: 0, 4: 2, 5: 0, 6: 0, 7: 1, 8: 0}
    assert got[2].text.startswith("O COMEÇO certo") and got[8].text.startswith("Capítulo 2 certo")  # titles that stand once stay


def test_scan_noise_asks_for_pairs(spark, monkeypatch):
    # by its letters 'cas@' may be 'casa' or 'caso'; only the neighbours tell
    rows = [*enumerate(["minha casa velha", "primeiro caso novo"] * 40), (900, "minha cas@ velha"), (901, "primeiro cas@ novo"), (902, "minha casa"), (903, None)]
    df = spark.createDataFrame(rows, "k bigint, t string")
    for most in (0, 1_000_000):  # pairs joined, and pairs broadcast
        monkeypatch.setattr(scan_noise, "ASKED_BROADCAST", most)
        got = {r.k: (r.text, r.replaced) for r in scan_noise.repaired(df, ["k"], "t").collect()}
        assert len(got) == len(rows) and got[900] == ("minha casa velha", 1) and got[901] == ("primeiro caso novo", 1) and got[902] == ("minha casa", 0) and got[903] == (None, 0)
        assert {r.k for r in scan_noise.repaired(df, ["k"], "t", noisy_only=True).collect()} == {900, 901}


def test_scan_noise_empty_table(spark):
    assert scan_noise.repaired(spark.createDataFrame([], "k bigint, t string"), ["k"], "t").count() == 0


def test_weighted_distance():
    assert scan_noise.distance("rnesmo", "mesmo") == scan_noise.CONFUSION and scan_noise.distance("abcdef", "uvwxyz") > scan_noise.WITH_CONTEXT
    assert scan_noise.distance("memoria", "memória") == scan_noise.ACCENT and scan_noise.distance("x", "x") == 0
