from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.registry import cleaned_view, register
from palimpsest.operators import layout
from palimpsest.plans import pipeline
from palimpsest.sources import files, ledger
from palimpsest.streaming import incremental


def glyphs(spark, lines):
    rows, k = [], 0
    for text, top, bottom, left in lines:
        for i, ch in enumerate(text + "\n"):
            rows.append((1, k, ch, left + 5.0 * i, left + 5.0 * i + 5, top, bottom))
            k += 1
    return spark.createDataFrame(rows, "page_id bigint, ord int, ch string, left double, right double, top double, bottom double")


def test_layout(spark):
    g = glyphs(spark, [("corpo dois", 500.0, 490.0, 60.0), ("corpo um", 600.0, 590.0, 60.0), ("CABEÇALHO", 830.0, 820.0, 60.0), ("nota", 200.0, 195.0, 60.0), ("12", 30.0, 20.0, 60.0)])
    sizes = spark.createDataFrame([(1, 595.0, 842.0)], "page_id bigint, page_width double, page_height double")
    row = layout.assemble_pages(layout.classify_lines(layout.glyphs_to_lines(g), sizes)).first()
    assert (row.body, row.footnotes, row.single_column) == ("corpo um\ncorpo dois", "nota", True)
    two = [(f"esq{i}", 700.0 - 20 * i, 690.0 - 20 * i, 40.0) for i in range(3)] + [(f"dir{i}", 700.0 - 20 * i, 690.0 - 20 * i, 400.0) for i in range(3)]
    row = layout.assemble_pages(layout.classify_lines(layout.glyphs_to_lines(glyphs(spark, two)), sizes)).first()
    assert not row.single_column and row.body.startswith("esq0\nesq1\nesq2\ndir0")
    jump = spark.createDataFrame([(1, 0, "a", 0.0, 5.0, 800.0, 790.0), (1, 1, "b", 0.0, 5.0, 500.0, 490.0), (1, 2, None, 0.0, 5.0, 500.0, 490.0)], g.schema)
    assert [r.text for r in layout.glyphs_to_lines(jump).orderBy("line_no").collect()] == ["a", "b"]


def carried(spark, bodies, notes=None):
    rows = [("k", i, b, (notes or [""] * len(bodies))[i]) for i, b in enumerate(bodies)]
    return [r.text for r in layout.carried_pages(spark.createDataFrame(rows, "book_id string, page_no int, body string, footnotes string")).orderBy("page_no").collect()]


def test_books(spark):
    pages = spark.createDataFrame([("k", 1, "era ne", ""), ("k", 2, "cessário um\nimpor\x02", "nota 1"), ("k", 3, "tante", "")], "book_id string, page_no int, body string, footnotes string")
    assert layout.assemble_books(pages).first().raw_text == "era\fnecessário um\n\n\nnota 1\fimportante"
    assert carried(spark, ["era um", "cessário"]) == ["era um", "cessário"]
    assert carried(spark, ["um co\x02", "nhe\x02", "cimento"]) == ["um", "", "conhecimento"]
    assert carried(spark, ["era ne", "Outro"], ["nota", ""]) == ["era ne\n\nnota", "Outro"]
    assert carried(spark, ["aqui impor\x02"]) == ["aquiimpor"] and carried(spark, ["a in\x02terna xy"]) == ["a interna xy"]
    assert carried(spark, [None, "", "fim"]) == ["", "", "fim"]
    assert layout.assemble_books(pages.limit(0)).count() == 0


def test_breaks(spark):
    cases = {
        "Fim.\nNovo\nTÍTULO GRANDE\nignorá-\n-lo": "Fim.\n\nNovo\n\nTÍTULO GRANDE\n\nignorá-lo", "um\ndois\n": "um\ndois", "Fim.\n\nNovo": "Fim.\n\nNovo", "disse:\n— Sim": "disse:\n— Sim", "disse.\n— Sim": "disse.\n\n— Sim",
        "": "", "fim.\nnovo": "fim.\nnovo", "AAAA-\n-lo": "AAAA-\n\n-lo", "  a  \n b ": "a\nb",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", layout.with_breaks(F.col("t"))).collect()}
    assert got == {**cases, None: None}


class Pages:
    def count(self, content):
        return len(content.split(b"|"))

    def texts(self, content, pages):
        return [content.split(b"|")[p - 1].decode() for p in pages]


def test_sources(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes("|".join(f"página {i}" for i in range(1, 61)).encode())
    (tmp_path / "a.pdf").write_bytes(b"x|y")
    (tmp_path / "Nota.TXT").write_text("o conheci-\nmento", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"z")
    here = str(tmp_path)
    assert [r.name for r in files.discover_pdfs(spark, here).collect()] == ["a.pdf", "b.pdf"]
    pages = files.read_pages(spark, here, Pages())
    assert pages.count() == 52 and files.read_pages(spark, here, Pages(), full=True).count() == 62
    engines = {r.path.rsplit("/")[-1]: r.engine for r in files.adaptive_pages(pages, pages).select("path", "engine").distinct().collect()}
    assert engines == {"a.pdf": "ocr", "b.pdf": "native"}
    assert files.first_pages(pages, 2).filter("path like '%a.pdf'").first().text == "x\ny"
    text = files.read_texts(spark, here)
    done = pipeline.process(text)
    assert done.first().structured_text == "o conhecimento\n" and "raw_sha256" in done.first().report
    assert ledger.export_files(done, str(tmp_path / "out"), "name", "structured_text", "txt") == 1
    assert (tmp_path / "out" / "Nota.TXT.limpo.txt").read_text(encoding="utf-8").strip() == "o conhecimento"
    with pytest.raises(ValueError):
        ledger.export_files(done, here, "name", "structured_text", "pdf")


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        ledger.read_ledger(spark, str(tmp_path / "broken")).collect()
    assert ledger.read_ledger(spark, path).count() == 0
    ledger.append_ledger(spark.createDataFrame([("b", "s", "success")], "batch_id string, slug string, status string"), path)
    ledger.append_ledger(spark.createDataFrame([("b", "t", "failed")], "batch_id string, slug string, status string"), path)
    rows = spark.createDataFrame([(1, "s", "x"), (2, "t", "y")], "extraction_id int, slug string, raw_text string")
    assert [r.slug for r in pipeline.resume(rows, ledger.read_ledger(spark, path)).collect()] == ["t"]


def test_stream(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("extraction_id"), F.concat(F.lit("pala-\nvra "), "id").alias("raw_text"), F.lit("native").alias("engine"), F.timestamp_seconds(F.lit(1.9e9) + F.col("id")).alias("received_at"))
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows.write.parquet(src)
    run = lambda: incremental.clean_stream(incremental.extraction_stream(spark, src, rows), out, at).awaitTermination()
    run()
    rows.limit(5).write.mode("append").parquet(src)  # delivered twice
    run()
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.filter("structured_text like 'palavra%'").count() == 20
    assert incremental.arrivals(rows).agg(F.sum("texts")).first()[0] == 20


def test_stream_files_in_no_order_of_time(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    day = lambda ids, days: spark.createDataFrame([(i, f"texto {i}", "native") for i in ids], "extraction_id bigint, raw_text string, engine string").withColumn("received_at", F.timestamp_seconds(F.lit(1.9e9 + 86400 * days))).coalesce(1)
    for ids, days in (((1, 2, 3), 900), ((4, 5, 6, 1), 0), ((7, 8, 9, 5), 450)):  # the newest first, two rows again
        day(ids, days).write.mode("append").parquet(src)
    rows = day((0,), 0)
    run = lambda: incremental.clean_stream(incremental.extraction_stream(spark, src, rows, files=1), out, at).awaitTermination()
    run()
    assert sorted(r.extraction_id for r in spark.read.parquet(out).collect()) == [*range(1, 10)]
    day((10, 2, 7), -900).write.mode("append").parquet(src)  # a later call, older than all before
    run()
    assert sorted(r.extraction_id for r in spark.read.parquet(out).collect()) == [*range(1, 11)]


def test_registry(spark):
    register(spark)
    assert spark.sql("select seq_ratio('abcd', 'bcde')").first()[0] == 0.75
    assert list(spark.sql("select strip_text('\u00a0 a b\u2003'), fold(' ÀÇã Straße ')").first()) == ["a b", "aca strasse"]
    spark.createDataFrame([(1, "o conheci-\nmento")], "k int, t string").createOrReplaceTempView("raw_rows")
    cleaned_view(spark, "raw_rows", "t", "clean_rows")
    assert spark.sql("select clean_text from clean_rows").first()[0] == "o conhecimento\n"
    assert [r.chunk for r in spark.sql("select * from chunk_rows('aa\n\nbbb', 3)").collect()] == ["aa", "bbb"]
