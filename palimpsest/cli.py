"""Commands over folders: extract, batch-extract, prepare-review, check, import-review, export.

Each runs one Spark job over all files of a folder and writes Parquet tables beside each other. A PDF
backend or a checker is named as ``module:attribute`` and imported here and on the workers. A failed command
says why on standard error and ends with status 1.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batch, metadata, review
from .plans import pipeline
from .runtime import materialize, ship
from .sources import files, ledger


#: What a reviewer is asked for, as it stands in the manifests.
INSTRUCTIONS = "Correct spelling, accents, agreement and punctuation of every chunk; keep meaning, order and headings; join the chunks and import them as one file."


def _named(what: str):
    module, _, name = what.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


def _slugged(df: DataFrame) -> DataFrame:
    if "meta_slug" not in df.columns:
        df = df.withColumn("meta_slug", metadata.slug_part(metadata.file_stem(F.col("name")), 120))
    return df.withColumnRenamed("meta_slug", "slug")


def _raw(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(name, raw_text, engine, slug, first, last, attempts, error, ...) of the folder: text files, or PDF pages through the backends.

    A book that could not be read has an error instead of a text.
    """
    if not args.backend:
        rows = files.read_texts(spark, args.input).withColumn("input_pdf", F.col("path"))
        return _slugged(rows.withColumns({"first": F.lit(None).cast("int"), "last": F.lit(None).cast("int"), "attempts": F.lit(1), "error": F.lit(None).cast("string")}))
    pages = materialize(files.adaptive_books(spark, args.input, _named(args.backend), _named(args.ocr) if args.ocr else None, spec=args.pages, full=args.full, retries=args.retries), "pages")
    read = pages.filter("error is null")
    about = pages.groupBy("path").agg(F.first("engine").alias("engine"), F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.max("attempts").alias("attempts"), F.max("error").alias("error"))
    books = about.join(files.books_from_pages(read, args.separator), "path", "left").join(files.first_pages(read), "path", "left")
    named = books.withColumn("name", F.regexp_extract("path", r"([^/]*)\z", 1))
    return _slugged(metadata.extract_metadata(named, "text", "name").drop("text").withColumnRenamed("path", "input_pdf"))


def _process(raw: DataFrame, args: argparse.Namespace) -> DataFrame:
    return pipeline.process(raw, enhanced=args.enhanced, reflow=not args.no_reflow, drop_leading_pages=args.drop_leading_pages)


def _artefacts(done: DataFrame) -> DataFrame:
    """Where a book's raw and cleaned texts and its report belong: a folder for its pages."""
    pages = F.when(F.col("first").isNotNull(), batch.pages_slug(F.col("first"), F.col("last"))).otherwise(F.lit("texto"))
    return done.withColumn("pages_dir", F.concat_ws("/", "slug", pages))


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    """The books of a folder; one that cannot be read fails the command."""
    raw = _raw(spark, args)
    bad = raw.filter("error is not null").select("name", "error").first()
    if bad:
        raise ValueError(f"{bad.name}: {bad.error}")
    _artefacts(_process(raw, args)).write.mode("overwrite").parquet(f"{args.output}/books")
    return 0


def batch_extract(spark: SparkSession, args: argparse.Namespace) -> int:
    """Books without a success on record, if so asked, else all; every book taken gets a row in the ledger, the failed with their error, when the texts are written.

    With ``--fail-fast`` nothing is cleaned if any book could not be read. Status 1 tells that a book failed.
    """
    raw = materialize(_raw(spark, args), "raw")
    past = ledger.read_ledger(spark, f"{args.output}/ledger")
    wanted = batch.to_process(raw, past) if args.resume else raw
    stamp = spark.sql("select date_format(current_timestamp(), 'yyyy-MM-dd_HH-mm-ss')").first()[0]
    out = f"{args.output}/books/batch={stamp}"
    failed = wanted.filter("error is not null")
    common = [F.lit(stamp).alias("batch_id"), "name", "slug", "input_pdf", F.when(F.col("first").isNotNull(), F.struct("first", "last")).alias("pages"), "attempts", F.current_timestamp().alias("recorded_at")]
    rows = failed.select(*common, F.lit("failed").alias("status"), F.left("error", F.lit(files.ERROR_CHARS)).alias("error"))
    any_failed = not failed.isEmpty()
    if not (args.fail_fast and any_failed):
        _artefacts(_process(wanted.filter("error is null"), args)).write.parquet(out)
        done = spark.read.parquet(out)
        if args.checker:
            proposals = _checked(done.select("name", F.col("structured_text").alias("text")), args)
            review.suggestions_record(proposals).write.mode("overwrite").parquet(f"{args.output}/suggestions/batch={stamp}")
        known = {"output_dir": F.concat_ws("/", F.lit(out), "pages_dir"), "cleaned_sha256": F.sha2("structured_text", 256), "lt_local": F.lit("done" if args.checker else None).cast("string")}
        known |= {"metadata_confidence": F.col("meta_confidence")} if "meta_confidence" in done.columns else {}
        rows = rows.unionByName(done.withColumns(known).select(*common, F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), *known), allowMissingColumns=True)
    ledger.append_ledger(rows, f"{args.output}/ledger")
    return int(any_failed)


def _books(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(f"{args.output}/books").select("name", F.col("structured_text").alias("text"))


def prepare_review(spark: SparkSession, args: argparse.Namespace) -> int:
    books = _books(spark, args)
    review.chunk_rows(books, ["name"], "text", args.size).write.mode("overwrite").parquet(f"{args.output}/chunks")
    review.dated_manifest(books, "text", size=args.size, instructions=INSTRUCTIONS).write.mode("overwrite").parquet(f"{args.output}/manifests")
    return 0


def _checked(books: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Books with the matches of the checker and the proposal made of them."""
    found = review.check_texts(books, ["name"], "text", _named(args.checker), size=args.size)
    kind = "array<struct<offset:bigint,length:bigint,message:string,replacements:array<struct<value:string>>>>"
    lists = found.groupBy("name").agg(F.collect_list(F.struct("offset", "length", "message", "replacements")).alias("matches"))
    rows = books.join(lists, "name", "left").withColumn("matches", F.coalesce("matches", F.array().cast(kind)))
    return rows.withColumn("p", review.apply_suggestions(F.col("text"), F.col("matches"))).select("name", "text", "matches", "p.*")


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    done = _checked(_books(spark, args), args)
    review.import_correction(done, "text", "proposal").write.mode("overwrite").parquet(f"{args.output}/proposals")
    review.suggestions_record(done).write.mode("overwrite").parquet(f"{args.output}/suggestions")
    return 0


def import_review(spark: SparkSession, args: argparse.Namespace) -> int:
    """Corrected texts of a folder, named as the books, against what they were made from."""
    corrected = files.read_texts(spark, args.input).select("name", F.col("raw_text").alias("corrected"))
    expected = spark.read.parquet(f"{args.output}/manifests").select("name", "source_sha256")
    rows = _books(spark, args).join(corrected, "name").join(expected, "name", "left")
    review.import_correction(rows, "text", "corrected", "source_sha256").write.mode("overwrite").parquet(f"{args.output}/corrections")
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    ledger.export_files(_books(spark, args), args.input, "name", "text", args.format)
    return 0


COMMANDS = {"extract": extract, "batch-extract": batch_extract, "prepare-review": prepare_review, "check": check, "import-review": import_review, "export": export}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--input", help="folder to read; for export, the folder to write files into")
    p.add_argument("--output", required=True, help="folder of the tables")
    p.add_argument("--backend", help="PDF backend, module:attribute; without it text files are read")
    p.add_argument("--ocr", help="optical reader, module:attribute, for books with too little text of their own")
    p.add_argument("--separator", default="\f", help="what stands between native pages")
    p.add_argument("--retries", type=int, default=0, help="further attempts at a book that cannot be read")
    p.add_argument("--fail-fast", action="store_true", help="clean nothing if a book cannot be read")
    p.add_argument("--no-reflow", action="store_true", help="keep the lines of paragraphs")
    p.add_argument("--drop-leading-pages", type=int, default=0)
    p.add_argument("--checker", help="function from a chunk to matches, module:attribute")
    p.add_argument("--pages", help="page range such as 21-30")
    p.add_argument("--full", action="store_true", help="whole books instead of a sample")
    p.add_argument("--enhanced", action="store_true")
    p.add_argument("--resume", action="store_true", help="skip books with a success on record")
    p.add_argument("--size", type=int, default=review.MANUAL_CHUNK)
    p.add_argument("--format", choices=["md", "txt"], default="md")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    try:
        return COMMANDS[args.command](spark, args)
    except Exception as e:
        print(f"{args.command}: {str(e)[:500]}", file=sys.stderr)
        return 1


