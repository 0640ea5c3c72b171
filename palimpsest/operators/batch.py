"""Batches of books: page ranges, the ledger of runs, resuming.

The ledger is append-only; what holds for a book is its latest row, and a success once recorded is not
forgotten by later rows about skipping it. Exact repeats of a row count once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import strip

SAMPLE = "1-50"


def parse_page_range(spec: Column) -> Column:
    """Pages of 'a-b' or 'a', from 1; raises for anything else."""
    s = strip(spec)
    first = F.regexp_extract(s, r"\A\s*\+?(\d+)", 1).cast("int")
    last = F.when(F.contains(s, F.lit("-")), F.regexp_extract(s, r"-\s*(\d+)\s*\z", 1)).otherwise(F.regexp_extract(s, r"\A\s*\+?(\d+)\s*\z", 1))
    last = F.nullif(last, F.lit("")).cast("int")
    good = s.rlike(r"\A\+?\d+(\s*-\s*\d+)?\z") & (first >= 1) & (last >= first)
    return F.when(good, F.sequence(first, last)).when(spec.isNotNull(), F.raise_error(F.concat(F.lit("invalid page range: "), s)).cast("array<int>"))


def resolve_pages(spec: Column, total: Column, full: Column) -> Column:
    """The pages to take of a book of ``total``: all, or the range, or the sample, cut at the end; raises if none is left."""
    wanted = F.filter(parse_page_range(F.coalesce(spec, F.lit(SAMPLE))), lambda p: p <= total)
    bad = lambda text: F.raise_error(F.concat(F.lit(text), total.cast("string"))).cast("array<int>")
    return F.when(total < 1, bad("no pages: ")).when(full, F.sequence(F.lit(1), total)).when(F.size(wanted) > 0, wanted).otherwise(bad("range begins after the last page: "))


def wanted_pages(spec: str | None, total: int, full: bool = False) -> list[int]:
    """The same as ``resolve_pages``, for a reader that has a book in its hands; raises ValueError."""
    if total < 1:
        raise ValueError(f"no pages: {total}")
    if full:
        return list(range(1, total + 1))
    m = re.fullmatch(r"\+?(\d+)(?:\s*-\s*(\d+))?", (SAMPLE if spec is None else spec).strip())
    first, last = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
    if not 1 <= first <= last:
        raise ValueError(f"invalid page range: {spec}")
    if first > total:
        raise ValueError(f"range begins after the last page: {total}")
    return list(range(first, min(last, total) + 1))


def pages_slug(first: Column, last: Column) -> Column:
    return F.format_string("pages-%03d-%03d", first, last)


def latest(ledger: DataFrame, *keys: str, at: str = "recorded_at") -> DataFrame:
    """The last row of each key; equal times are settled by the row's own values."""
    ties = [F.col(c).desc_nulls_last() for c, kind in ledger.dtypes if c not in (*keys, at) and not kind.startswith(("map", "array", "struct"))]
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *ties)
    return ledger.withColumn("__pal_rank", F.row_number().over(order)).filter("__pal_rank = 1").drop("__pal_rank")


def completed_slugs(ledger: DataFrame) -> DataFrame:
    """Slugs with a success on record."""
    return ledger.filter("status = 'success' and slug is not null").select("slug").distinct()


def to_process(books: DataFrame, ledger: DataFrame) -> DataFrame:
    """Books without a success on record."""
    return books.join(completed_slugs(ledger), "slug", "left_anti")


def to_skip(books: DataFrame, ledger: DataFrame) -> DataFrame:
    return books.join(completed_slugs(ledger), "slug", "left_semi")


def batch_totals(ledger: DataFrame) -> DataFrame:
    """Books of each batch by the latest status: total, processed, succeeded, failed, skipped."""
    last = latest(ledger, "batch_id", "slug")
    is_ = lambda s: F.count_if(F.col("status") == s)
    return last.groupBy("batch_id").agg(F.count("*").alias("total_books"), (is_("success") + is_("failed")).alias("processed"), is_("success").alias("succeeded"), is_("failed").alias("failed"), is_("skipped").alias("skipped"))


def collisions(books: DataFrame, path_col: str = "input_pdf") -> DataFrame:
    """Slugs that more than one input would write under."""
    return books.groupBy("slug").agg(F.countDistinct(path_col).alias("inputs")).filter("inputs > 1")
