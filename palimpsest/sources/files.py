"""Reading books from files.

PDF needs a backend that is not part of this package: an object with ``count(bytes) -> int`` and
``texts(bytes, pages) -> list[str]``, imported on the workers. Page ranges are resolved before a backend is
called, so only the wanted pages are read. Text files need nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import strip
from ..operators.batch import wanted_pages
from ..runtime import broadcast_if_small, materialize

#: Characters of native text from which on a book is not read optically.
NATIVE_CHARS = 200


class Backend(Protocol):
    def count(self, content: bytes) -> int: ...

    def texts(self, content: bytes, pages: list[int]) -> list[str]: ...


def discover_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length) of the PDF files of a folder, not of its subfolders, by path; raises if there is no folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder).select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "length").orderBy("path")


def page_counts(spark: SparkSession, folder: str, backend: Backend) -> DataFrame:
    """(path, total) of every PDF file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "total": [backend.count(bytes(c)) for c in part["content"]]})

    return files.mapInPandas(run, "path string, total int")


PAGES = "path string, page_no int, text string, attempts int, error string"
#: Characters of an error that are kept.
ERROR_CHARS = 200


def read_books(files: DataFrame, backend: Backend, *, spec: str | None = None, full: bool = False, retries: int = 0) -> DataFrame:
    """(path, page_no, text, attempts, error) of the wanted pages of (path, content), counted, resolved and read in one pass.

    A sample of 50 pages is taken unless told otherwise. A book that fails is tried ``retries`` times more and then gives one row
    with the error and neither page nor text; the others go on.
    """

    def one(content: bytes) -> tuple[list[int], list[str]]:
        own = wanted_pages(spec, backend.count(content), full)
        return own, backend.texts(content, own)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in part[["path", "content"]].itertuples(index=False, name=None):
                for attempt in range(1, retries + 2):
                    try:
                        pages, texts = one(bytes(content))
                        yield pd.DataFrame({"path": path, "page_no": pages, "text": texts, "attempts": attempt, "error": None})
                        break
                    except Exception as e:
                        error = str(e)[:ERROR_CHARS] or type(e).__name__
                else:
                    yield pd.DataFrame({"path": [path], "page_no": pd.array([None], "Int32"), "text": [None], "attempts": [retries + 1], "error": [error]})

    return files.mapInPandas(run, PAGES)


def pdf_contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def read_pages(spark: SparkSession, folder: str, backend: Backend, *, spec: str | None = None, full: bool = False) -> DataFrame:
    """(path, page_no, text) of the wanted pages of every book that could be read."""
    return read_books(pdf_contents(spark, folder), backend, spec=spec, full=full).filter("error is null").select("path", "page_no", "text")


def native_chars() -> Column:
    return F.length(strip(F.coalesce("text", F.lit(""))))


def adaptive_books(spark: SparkSession, folder: str, native: Backend, optical: Backend | None, *, spec: str | None = None, full: bool = False, retries: int = 0) -> DataFrame:
    """Pages as of ``read_books`` with their engine: books short of ``NATIVE_CHARS`` characters of their own are read optically, and no others.

    The native pages are written once, so that neither reader runs twice over a book. Without an optical reader such books
    give an error row.
    """
    files = pdf_contents(spark, folder)
    own = materialize(read_books(files, native, spec=spec, full=full, retries=retries), "native")
    books = own.filter("error is null").groupBy("path").agg(F.sum(native_chars()).alias("chars"))
    poor = books.filter(F.col("chars") < NATIVE_CHARS).select("path")
    kept = own.join(poor, "path", "left_anti").withColumn("engine", F.lit("native"))
    if optical is None:
        missing = poor.select("path", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("attempts"), F.lit("too little native text and no optical reader").alias("error"), F.lit("ocr").alias("engine"))
        return kept.unionByName(missing)
    # contents are read again for the chosen paths only; a broadcast of paths, where it fits, keeps them out of a shuffle
    chosen = files.join(broadcast_if_small(poor, poor.count()), "path", "left_semi")
    return kept.unionByName(read_books(chosen, optical, spec=spec, full=full, retries=retries).withColumn("engine", F.lit("ocr")))


def adaptive_pages(native: DataFrame, optical: DataFrame) -> DataFrame:
    """Pages of ``native`` for books with enough text of their own, of ``optical`` for the others, and the engine; for pages that are there already."""
    rich = native.groupBy("path").agg(F.sum(native_chars()).alias("chars")).filter(F.col("chars") >= NATIVE_CHARS).select("path")
    own = native.join(rich, "path", "left_semi").withColumn("engine", F.lit("native"))
    return own.unionByName(optical.join(rich, "path", "left_anti").withColumn("engine", F.lit("ocr")))


def books_from_pages(pages: DataFrame, separator: str = "\f") -> DataFrame:
    """(path, raw_text): pages in order; a book must fit a cell."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("path").agg(F.array_join(F.transform(rows, lambda x: F.coalesce(x["text"], F.lit(""))), separator).alias("raw_text"))


def first_pages(pages: DataFrame, n: int = 10) -> DataFrame:
    """(path, text): the first ``n`` pages that have text, joined by line ends."""
    return books_from_pages(pages.filter((F.col("page_no") <= n) & (F.length(F.coalesce("text", F.lit(""))) > 0)), "\n").withColumnRenamed("raw_text", "text")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, raw_text, engine) of .txt and .md files, whatever the case of the ending."""
    rows = spark.read.option("pathGlobFilter", "*.{txt,md,TXT,MD,Txt,Md}").text(folder, wholetext=True)
    path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return rows.select(path.alias("path"), F.regexp_extract(path, r"([^/]*)\z", 1).alias("name"), F.col("value").alias("raw_text"), F.lit("texto").alias("engine"))
