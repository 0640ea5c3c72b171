from __future__ import annotations

from palimpsest import cli


def find_mesmo(chunk):
    at = chunk.find("mesmo")
    return [{"offset": at, "length": 5, "message": "repetido", "replacements": [{"value": "próprio"}]}] if at >= 0 else []


def test_commands(spark, tmp_path):
    books, out, files = (tmp_path / x for x in ("in", "out", "files"))
    books.mkdir()
    (books / "Um Livro.txt").write_text("1. Um título\n\nO mes-\nmo conselho antigo.", encoding="utf-8")
    (books / "b.md").write_text("Outro texto.", encoding="utf-8")
    run = lambda *a: cli.main([*a, "--output", str(out)])
    assert run("batch-extract", "--input", str(books)) == 0
    assert spark.read.parquet(f"{out}/ledger").count() == 2
    (books / "c.txt").write_text("Novo.", encoding="utf-8")
    assert run("batch-extract", "--input", str(books), "--resume") == 0
    assert spark.read.parquet(f"{out}/books").count() == 3 and spark.read.parquet(f"{out}/ledger").count() == 3
    assert run("prepare-review") == 0 and spark.read.parquet(f"{out}/manifests").count() == 3
    assert run("check", "--checker", "test_cli:find_mesmo") == 0
    done = {r.name: r for r in spark.read.parquet(f"{out}/proposals").collect()}
    assert done["Um Livro.txt"].proposal == "## 1. Um título\n\nO próprio conselho antigo.\n" and not done["b.md"].changed
    assert run("export", "--input", str(files), "--format", "txt") == 0 and len(list(files.iterdir())) == 3
    fixed = tmp_path / "fixed"
    fixed.mkdir()
    (fixed / "b.md").write_text("Outro texto corrigido.\n", encoding="utf-8")
    assert run("import-review", "--input", str(fixed)) == 0
    row = spark.read.parquet(f"{out}/corrections").first()
    assert row.changed and row.source_hash_matches and "+Outro texto corrigido." in row.diff
    assert run("extract", "--input", str(tmp_path / "missing")) == 1


class Shelf:
    """Pages between bars; a book that says BROKEN cannot be read."""

    def count(self, content):
        if b"BROKEN" in content:
            raise ValueError("cannot be read " + "x" * 400)
        return len(content.split(b"|"))

    def texts(self, content, pages):
        return [content.split(b"|")[p - 1].decode() for p in pages]


class Optical(Shelf):
    """Leaves a file for every book it is asked to read."""

    def texts(self, content, pages):
        import uuid

        with open(f"/tmp/palimpsest-optical-{content[:8].decode()}-{uuid.uuid4().hex}", "w"):
            pass
        return [f"lido opticamente {p}" for p in pages]


def test_batch_with_a_bad_book(spark, tmp_path):
    import glob
    import os

    books, out = tmp_path / "in", tmp_path / "out"
    books.mkdir()
    (books / "bom.pdf").write_bytes(b"|".join([b"Um texto longo e bom de uma pagina inteira. " * 6] * 3))
    (books / "mau.pdf").write_bytes(b"BROKEN")
    (books / "scan.pdf").write_bytes(b"scanscan|x")
    for f in glob.glob("/tmp/palimpsest-optical-*"):
        os.remove(f)
    run = lambda *a: cli.main([*a, "--input", str(books), "--output", str(out), "--backend", "test_cli:Shelf"])
    assert run("batch-extract", "--ocr", "test_cli:Optical", "--retries", "2", "--full") == 1
    rows = {r.name: r for r in spark.read.parquet(f"{out}/ledger").collect()}
    assert {k: (r.status, r.attempts) for k, r in rows.items()} == {"bom.pdf": ("success", 1), "mau.pdf": ("failed", 3), "scan.pdf": ("success", 1)}
    assert rows["mau.pdf"].error.startswith("cannot be read") and len(rows["mau.pdf"].error) == 200 and rows["bom.pdf"].output_dir.endswith("/pages-001-003")
    done = {r.name: r for r in spark.read.parquet(f"{out}/books").collect()}
    assert set(done) == {"bom.pdf", "scan.pdf"} and done["scan.pdf"].engine == "ocr" and "lido opticamente 2" in done["scan.pdf"].structured_text and done["bom.pdf"].engine == "native"
    assert {os.path.basename(f).split("-")[2] for f in glob.glob("/tmp/palimpsest-optical-*")} == {"scanscan"}  # no other book was read optically
    (books / "mau.pdf").write_bytes(b"agora bom " * 30)
    assert run("batch-extract", "--resume", "--full", "--drop-leading-pages", "0", "--no-reflow") == 0  # scan.pdf is done, so it needs no optical reader now
    rows = spark.read.parquet(f"{out}/ledger").filter("status = 'success'").collect()
    assert sorted(r.name for r in rows) == ["bom.pdf", "mau.pdf", "scan.pdf"]
    (books / "mau2.pdf").write_bytes(b"BROKEN")
    before = spark.read.parquet(f"{out}/books").count()
    assert run("batch-extract", "--fail-fast", "--full") == 1 and spark.read.parquet(f"{out}/books").count() == before
    assert run("extract", "--full") == 1
    for f in glob.glob("/tmp/palimpsest-optical-*"):
        os.remove(f)
