from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.similarity import diff, ratio
from palimpsest.operators import batch, metadata, review

MATCHES = "array<struct<offset:bigint,length:bigint,message:string,replacements:array<struct<value:string>>>>"


def proposal(spark, text, matches):
    rows = [(text, [(o, n, None, None if v is None else [(x,) for x in v]) for o, n, v in matches] if matches is not None else None)]
    return tuple(spark.createDataFrame(rows, f"t string, m {MATCHES}").select(review.apply_suggestions(F.col("t"), F.col("m")).alias("p")).select("p.*").first())


def test_suggestions(spark):
    assert proposal(spark, "Ele foi na escola.", [(4, 6, ["foi à"])]) == ("Ele foi à escola.", 1)
    assert proposal(spark, "abcdef", [(2, 2, ["X"]), (0, 1, ["Y"]), (3, 2, ["Z"])]) == ("YbXef", 2)
    assert proposal(spark, "abc", [(0, 1, []), (1, 1, None), (2, 9, ["X"]), (None, 1, ["Q"]), (0, 0, ["<"])]) == ("<abc", 1)
    assert proposal(spark, "abc", None) == ("abc", 0)
    assert proposal(spark, "abc", [(1, 1, ["X"]), (1, 1, ["X"])]) == ("aXc", 1)


def chunks(spark, text, size):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return [(r.char_offset, r.chunk) for r in review.chunk_rows(df, ["id"], "t", size).orderBy("chunk_no").collect()]


def test_chunks(spark):
    assert [len(c) for _, c in chunks(spark, "a" * 120_000, 50_000)] == [50_000, 50_000, 20_000]
    assert chunks(spark, "p1\n\np2\n\np3", 100) == [(0, "p1\n\np2\n\np3")]
    assert chunks(spark, "p1\n\n" + "x" * 5, 5) == [(0, "p1"), (4, "xxxxx")]
    assert chunks(spark, "", 5) == [] and chunks(spark, None, 5) == []
    text = "um\n\n\n\ndois três\n\n" + "quatro" * 9 + "\n\num"
    for at, c in chunks(spark, text, 11):
        assert text[at : at + len(c)] == c and len(c) <= 11


def test_checker_offsets(spark):
    df = spark.createDataFrame([(1, "aaa\n\nbbb")], "id int, t string")
    got = review.check_texts(df, ["id"], "t", lambda c: [{"offset": 0, "length": 1, "message": c}], size=3).orderBy("offset").collect()
    assert [(r.offset, r.message) for r in got] == [(0, "aaa"), (5, "bbb")]


def test_manifest_and_import(spark):
    m = review.manifest(spark.createDataFrame([("abc",)], "t string"), "t").first()
    assert (m.char_count, m.chunk_count, m.chunk_sizes) == (3, 1, [3]) and m.source_sha256.startswith("ba7816bf")
    df = spark.createDataFrame([("a\n", "b\n", m.source_sha256), ("abc", "abc", m.source_sha256), ("x", "x", None), (None, "x", None)], "o string, c string, h string")
    got = review.import_correction(df, "o", "c", "h").collect()
    assert [(r.changed, r.source_hash_matches, bool(r.diff)) for r in got] == [(True, False, True), (False, True, False), (False, None, False), (None, None, False)]
    assert "-a" in got[0].diff and "+b" in got[0].diff


def test_similarity():
    assert ratio("abcd", "bcde") == 0.75 and ratio("", "") == 1.0 and ratio("a", "") == 0.0 and ratio(None, "a") is None
    assert ratio("uma pagina de teste", "uma pagina de texto") == 0.8947368421052632 and diff("a", "a") == ""


def test_plain_text(spark):
    df = spark.createDataFrame([("# T\n\n- um\ntexto # fim\n##x",)], "t string")
    assert df.select(review.to_plain_text(F.col("t"))).first()[0] == "T\n\n— um\ntexto # fim\nx"


def test_metadata(spark):
    good = "Jaeger, Werner Wilhelm, 1888-1961\nPaideia : a formação do homem\nISBN 978-85-7827-670-6\n"
    rows = [(1, good, "/in/Paideia.pdf"), (2, "I - LEVEQUE, Pierre sem data", "As Primeiras (1).pdf"), (3, None, "Ação.Ü.pdf"), (4, "Silva, J o ã o, 1900-1950 ISBN 85-123-4567-8", "x.pdf"), (5, "ISBN: 978", ".pdf"), (6, "", "")]
    got = {r.id: r for r in metadata.extract_metadata(spark.createDataFrame(rows, "id int, text string, f string"), "text", "f").collect()}
    assert (got[1].meta_author, got[1].meta_isbn, got[1].meta_confidence) == ("Werner Wilhelm Jaeger", "9788578276706", 0.85)
    assert got[1].meta_slug.startswith("werner-wilhelm-jaeger-paideia")
    assert (got[2].meta_source, got[2].meta_slug, got[2].meta_confidence) == ("filename", "as-primeiras-1", 0.55)
    assert got[3].meta_slug == "acao-u" and got[4].meta_confidence == 0.73 and got[5].meta_source == "filename"


def test_page_ranges(spark):
    def resolve(spec, total, full=False):
        df = spark.createDataFrame([(spec, total, full)], "s string, t int, f boolean")
        return df.select(batch.resolve_pages(F.col("s"), F.col("t"), F.col("f"))).first()[0]

    assert resolve(None, 578) == list(range(1, 51)) and resolve(None, 30) == list(range(1, 31)) and resolve(None, 12, True) == list(range(1, 13)) and resolve(" 5 ", 9) == [5]
    for spec, total in (("100-110", 50), ("0-3", 9), ("5-2", 9), ("x", 9), (None, 0)):
        with pytest.raises(Exception):
            resolve(spec, total)


def test_ledger(spark):
    day = dt.datetime(2031, 3, 1)
    rows = [("b1", "x", "success", day), ("b1", "y", "failed", day), ("b2", "x", "skipped", day), ("b2", "y", "failed", day), ("b2", "y", "success", day + dt.timedelta(1)), ("b2", None, "success", day), ("b1", "x", "success", day)]
    ledger = spark.createDataFrame([(*r, f"{r[1]}.pdf") for r in rows], "batch_id string, slug string, status string, recorded_at timestamp, input_pdf string")
    books = spark.createDataFrame([("x",), ("y",), ("z",)], "slug string")
    assert {r.slug for r in batch.completed_slugs(ledger).collect()} == {"x", "y"}
    assert [r.slug for r in batch.to_process(books, ledger).collect()] == ["z"] and batch.to_skip(books, ledger).count() == 2
    assert {r.batch_id: r.succeeded for r in batch.batch_totals(ledger.distinct()).collect()} == {"b1": 1, "b2": 2}
