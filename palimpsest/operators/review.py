"""Preparing and importing a human review: chunks, offsets, manifests, proposals, diffs.

Suggestions never change a text; they make a proposal beside it. Chunks are greedy in the order of
paragraphs, so they are a fold over the document's own array, without a shuffle. Nulls stay null;
an empty text has no chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import unified

#: Characters of a chunk for the manual editor and for the local server, and the editor's own limit.
MANUAL_CHUNK, LOCAL_CHUNK, EDITOR_LIMIT = 50_000, 20_000, 60_000


def chunk_text(text: Column, size: int | Column = MANUAL_CHUNK) -> Column:
    """Paragraphs packed up to ``size`` characters; a longer one is cut into slices of its own."""
    size = F.lit(size) if isinstance(size, int) else size

    def step(acc: Column, p: Column) -> Column:
        cur, done = acc["cur"], acc["done"]
        both = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        flushed = F.when(cur == "", done).otherwise(F.concat(done, F.array(cur)))
        slices = F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), size), lambda i: F.substring(p, i + 1, size))
        make = lambda c, d: F.struct(c.alias("cur"), d.alias("done"))
        return F.when(F.length(both) <= size, make(both, done)).when(F.length(p) <= size, make(p, flushed)).otherwise(make(F.lit(""), F.concat(flushed, slices)))

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(F.split(text, "\n\n"), start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def chunk_offsets(text: Column, chunks: Column) -> Column:
    """Where each chunk begins in the text, from 0; each is sought behind the one before it."""

    def step(acc: Column, c: Column) -> Column:
        at = F.call_function("locate", c, text, F.element_at(acc, -1)["past"] + 1)
        return F.concat(acc, F.array(F.struct((at - 1).cast("int").alias("at"), (at - 1 + F.length(c)).cast("int").alias("past"))))

    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("past")))
    return F.aggregate(chunks, start, step, lambda acc: F.transform(F.slice(acc, 2, F.size(acc)), lambda x: x["at"]))


def chunk_rows(df: DataFrame, id_cols: list[str], text_col: str, size: int) -> DataFrame:
    """One row of each chunk: ids, chunk_no, char_offset, chunk."""
    c = df.select(*id_cols, F.col(text_col).alias("__t")).withColumn("__c", chunk_text(F.col("__t"), size))
    c = c.withColumn("__o", chunk_offsets(F.col("__t"), F.col("__c")))
    return c.select(*id_cols, F.posexplode(F.arrays_zip(F.col("__c").alias("chunk"), F.col("__o").alias("char_offset"))).alias("chunk_no", "x")).select(*id_cols, "chunk_no", "x.char_offset", "x.chunk")


def suggestions_record(done: DataFrame, engine: str = "local") -> DataFrame:
    """(name, engine, source_sha256, total_matches, applied_in_proposal, recorded_at, matches) of texts with their matches and proposals."""
    return done.select("name", F.lit(engine).alias("engine"), F.sha2("text", 256).alias("source_sha256"), F.size("matches").alias("total_matches"), F.col("applied").alias("applied_in_proposal"), F.current_timestamp().alias("recorded_at"), "matches")


def dated_manifest(df: DataFrame, text_col: str, *, size: int = MANUAL_CHUNK, language: str = "pt-BR", instructions: str | None = None) -> DataFrame:
    """``manifest`` with the time it was made and the instructions for the reviewer."""
    return manifest(df, text_col, size=size, language=language).withColumns({"created_at": F.current_timestamp(), "instructions": F.lit(instructions).cast("string")})


def manifest(df: DataFrame, text_col: str, *, size: int = MANUAL_CHUNK, language: str = "pt-BR") -> DataFrame:
    """``df`` with the review manifest's fields: hash, counts, limits and chunk sizes."""
    chunks = chunk_text(F.col(text_col), size)
    df = df.withColumn("__pal_chunks", chunks)
    out = df.withColumns({
        "language": F.lit(language), "source_sha256": F.sha2(F.col(text_col), 256), "char_count": F.length(text_col), "chunk_count": F.size("__pal_chunks"),
        "char_limit_per_request": F.lit(EDITOR_LIMIT), "chunk_sizes": F.transform("__pal_chunks", F.length),
    })
    return out.drop("__pal_chunks")


def sorted_matches(matches: Column) -> Column:
    """Matches by offset, length and position; those without an offset or length come last and are never applied."""
    ranked = F.transform(matches, lambda m, i: F.struct(m["offset"].isNull().alias("a"), m["offset"].alias("offset"), m["length"].isNull().alias("b"), m["length"].alias("length"), i.alias("i"), m["replacements"].alias("r")))
    keyed = F.transform(ranked, lambda m: F.struct(m["a"], m["offset"], m["b"], m["length"], m["i"], F.get(m["r"], F.lit(0))["value"].alias("value"), (F.size(m["r"]) > 0).alias("some")))
    return F.array_sort(keyed)


def apply_suggestions(text: Column, matches: Column) -> Column:
    """Struct of the proposal and how many first replacements went in, overlaps left out."""
    size = F.length(text)

    def step(acc: Column, m: Column) -> Column:
        start, end = m["offset"], m["offset"] + m["length"]
        ok = m["some"] & m["value"].isNotNull() & (start >= acc["cursor"]) & (end <= size)
        piece = F.concat(acc["out"], F.call_function("substring", text, (acc["cursor"] + 1).cast("int"), (start - acc["cursor"]).cast("int")), m["value"])
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(end.alias("cursor"), piece.alias("out"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("bigint").alias("cursor"), F.lit("").alias("out"), F.lit(0).alias("n"))
    rest = lambda acc: F.call_function("substring", text, (acc["cursor"] + 1).cast("int"), size)
    none = F.array().cast("array<struct<a:boolean,offset:bigint,b:boolean,length:bigint,i:int,value:string,some:boolean>>")
    return F.aggregate(F.coalesce(sorted_matches(matches), none), start, step, lambda acc: F.struct(F.concat(acc["out"], rest(acc)).alias("proposal"), acc["n"].alias("applied")))


def check_texts(df: DataFrame, id_cols: list[str], text_col: str, checker: Callable[[str], list[dict]], *, size: int = LOCAL_CHUNK) -> DataFrame:
    """Matches of a pluggable checker over every chunk, offsets moved to the whole text.

    ``checker`` takes a chunk and gives dicts with offset, length, message and replacements; it is called
    on the workers, once for each chunk.
    """
    chunks = chunk_rows(df, id_cols, text_col, size)
    kinds = dict(chunks.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                for m in checker(r["chunk"]):
                    rows.append({**{c: r[c] for c in id_cols}, "offset": m["offset"] + r["char_offset"], "length": m["length"], "message": m.get("message"), "replacements": [{"value": x.get("value")} for x in m.get("replacements") or []]})
            yield pd.DataFrame(rows, columns=[*id_cols, "offset", "length", "message", "replacements"])

    return chunks.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in id_cols) + ", offset bigint, length bigint, message string, replacements array<struct<value:string>>")


def import_correction(df: DataFrame, original_col: str, corrected_col: str, expected_sha_col: str | None = None) -> DataFrame:
    """``df`` with diff, changed and source_hash_matches (null without an expected hash)."""
    original, corrected = F.col(original_col), F.col(corrected_col)
    different = original != corrected
    text_diff = unified(F.when(different, original), F.when(different, corrected))
    hash_ok = (F.sha2(original, 256) == F.col(expected_sha_col)) if expected_sha_col else F.lit(None).cast("boolean")
    if expected_sha_col:
        hash_ok = F.when(F.coalesce(F.col(expected_sha_col), F.lit("")) != "", hash_ok)
    return df.withColumns({"diff": F.coalesce(text_diff, F.when(~different, F.lit(""))), "changed": different, "source_hash_matches": hash_ok})


def to_plain_text(markdown: Column) -> Column:
    """Markdown without heading marks, list marks as dashes."""
    lines = F.transform(F.split(F.regexp_replace(markdown, r"\n\z", ""), "\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\A#+\s*", ""), r"\A- ", "— "))
    return F.array_join(lines, "\n")
