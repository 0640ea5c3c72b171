"""The whole dataflow of a corpus: from raw texts to structured Markdown, chunks and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch, metadata, review
from ..operators.structure import clean_and_structure
from ..sources.ledger import report


def process(extractions: DataFrame, *, enhanced: bool = False, reflow: bool = True, drop_leading_pages: int = 0) -> DataFrame:
    """Extractions with cleaned and structured text, both counters, warnings and the JSON report."""
    return report(clean_and_structure(extractions, "raw_text", enhanced=enhanced, reflow_paragraphs=reflow, drop_leading_pages=drop_leading_pages), "raw_text")


def resume(extractions: DataFrame, ledger: DataFrame, *, enhanced: bool = False) -> DataFrame:
    """Only the books that have no success on record yet."""
    return process(batch.to_process(extractions, ledger), enhanced=enhanced)


def packages(structured: DataFrame, id_col: str = "extraction_id") -> tuple[DataFrame, DataFrame]:
    """Review chunks and manifests of structured texts."""
    rows = structured.select(id_col, F.col("structured_text").alias("text"))
    return review.chunk_rows(rows, [id_col], "text", review.MANUAL_CHUNK), review.manifest(rows, "text")


def catalogue(cards: DataFrame) -> DataFrame:
    return metadata.extract_metadata(cards, "text", "filename")
