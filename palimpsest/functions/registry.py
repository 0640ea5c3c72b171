"""Functions by name for SQL: strip_text, fold, seq_ratio, unified_diff, the table function chunk_rows, and views of cleaned texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.cleanup import clean_text
from .similarity import seq_ratio, unified
from .strings import WS_CHARS, fold_table


class ChunkRows:
    """Chunks of a text with their offsets, for SQL: SELECT * FROM chunk_rows(text, size)."""

    def eval(self, text: str | None, size: int) -> Iterator[tuple[int, int, str]]:
        if not text:
            return
        chunks: list[str] = []
        cur = ""
        for p in text.split("\n\n"):
            both = f"{cur}\n\n{p}" if cur else p
            if len(both) <= size:
                cur = both
                continue
            if cur:
                chunks.append(cur)
            cur = p if len(p) <= size else ""
            if not cur:
                chunks += [p[i : i + size] for i in range(0, len(p), size)]
        at = 0
        for n, c in enumerate([*chunks, cur] if cur else chunks):
            at = text.index(c, at)
            yield n, at, c
            at += len(c)


def register(spark: SparkSession) -> None:
    """Registers the functions in a session; strip_text and fold are expressions, the others Python."""
    spark.udf.register("seq_ratio", seq_ratio)
    spark.udf.register("unified_diff", unified)
    spark.udtf.register("chunk_rows", udtf(ChunkRows, returnType="chunk_no int, char_offset int, chunk string"))
    source, target = fold_table()
    for name, body in (
        ("strip_text", f"btrim(s, '{WS_CHARS}')"),
        ("fold", rf"replace(replace(lower(translate(regexp_replace(btrim(s, '{WS_CHARS}'), r'\p{{Mn}}+', ''), '{source}', '{target}')), 'ß', 'ss'), '\u0149', 'ʼn')"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")


def cleaned_view(spark: SparkSession, source: str, text_col: str, name: str, *, enhanced: bool = False) -> None:
    """A view ``name`` of a table or view with the cleaned text, counters and warnings of a column, for SQL."""
    clean_text(spark.table(source), text_col, enhanced=enhanced).createOrReplaceTempView(name)
