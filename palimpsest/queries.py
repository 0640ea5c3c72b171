"""The queries over the reference's operators, each over its whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.similarity import seq_ratio
from .functions.strings import fold, rstrip, split_lines, straight_quotes, strip, upper_ratio
from .operators import batch, cleanup, layout, metadata, review, structure
from .oracle import SQL as SQL
from .runtime import shared_dir, table
from .sources.ledger import report
from .streaming import incremental


def spread(df: DataFrame) -> DataFrame:
    """Small inputs lie in few files; heavy work on each row then needs more tasks than there are splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "extraction_results").select("extraction_id", "raw_text"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, once each: some are delivered twice."""
    return table(spark, sf_dir, "cleanup_results").select("cleanup_id", "text").distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("extraction_id", F.posexplode(F.split("raw_text", "\f")).alias("page_no", "page"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("extraction_id", "page_no", F.posexplode(split_lines(F.col("page"))).alias("line_no", "line"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("extraction_id", "page_no", F.length("page").alias("chars"), "page")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("stripped", strip(F.col("line")))


def leading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without its first two pages."""
    return _pages(spark, sf_dir).filter("page_no >= 2").groupBy("extraction_id").agg(F.count("*").alias("pages_left"))


def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default sample: pages up to number 50."""
    t = table(spark, sf_dir, "extraction_results").select("extraction_id", F.explode("pages").alias("page"))
    return t.filter("page <= 50").groupBy("extraction_id").agg(F.count("*").alias("sampled"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("line")
    flags = {"page_numbers": cleanup.is_page_number(x), "edge_garbage": cleanup.is_edge_garbage(x), "garbage_lines": cleanup.is_garbage_line(x), "toc_lines": (F.length(strip(x)) <= 90) & strip(x).rlike(cleanup.TOC_LINE), "capitals": layout.is_isolated_caps(strip(x))}
    return _lines(spark, sf_dir).groupBy("extraction_id").agg(*(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()))


def trailing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _lines(spark, sf_dir).withColumn("base", cleanup.without_trailing_number(F.col("line")))
    return own.filter(F.col("base") != strip(F.col("line"))).select("extraction_id", "page_no", "line_no", "base")


def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("folded", fold(F.col("line"))).filter("folded <> ''").groupBy("folded").agg(F.count("*").alias("n")).filter("n >= 2")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = cleanup.first_folds(F.split("raw_text", "\f"))
    return _raw(spark, sf_dir).filter(F.contains("raw_text", F.lit("\f"))).select("extraction_id", F.explode(first).alias("header")).groupBy("extraction_id", "header").agg(F.count("*").alias("n")).filter("n >= 2")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir)


def edge_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cleanup.edge_folds(F.split("raw_text", "\f"))
    return _raw(spark, sf_dir).filter(F.contains("raw_text", F.lit("\f"))).select("extraction_id", F.explode(edges).alias("header")).filter("header <> ''").groupBy("extraction_id", "header").agg(F.count("*").alias("n")).filter("n >= 2")


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are running headers of their text, alone or behind a page number: a semi-join on candidates."""
    s = strip(F.col("line"))
    keys = F.array(fold(s), F.when(s.rlike(cleanup.LEADING_NUMBER), fold(F.regexp_extract(s, cleanup.LEADING_NUMBER, 2))))
    candidates = _lines(spark, sf_dir).select("extraction_id", "page_no", "line_no", F.explode(F.array_distinct(F.array_compact(keys))).alias("header"))
    return candidates.join(_headers(spark, sf_dir), ["extraction_id", "header"], "left_semi").select("extraction_id", "page_no", "line_no").distinct()


def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text, the lines that are no running header: the anti-join to ``header_lines``."""
    every = _lines(spark, sf_dir).filter(strip(F.col("line")) != "").select("extraction_id", "page_no", "line_no")
    return every.join(header_lines(spark, sf_dir), ["extraction_id", "page_no", "line_no"], "left_anti").groupBy("extraction_id").agg(F.count("*").alias("n"))


def page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("extraction_id", "page_no", cleanup.noise_score(F.col("page")).alias("noise"), F.length("page").alias("chars"))


def best_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleanest page of each printed number of a text."""
    p = _pages(spark, sf_dir).withColumn("printed", cleanup.printed_number(F.col("page"))).filter("printed is not null")
    key = F.struct(cleanup.noise_score(F.col("page")).alias("a"), (-F.length("page")).alias("b"), F.col("page_no").alias("c"))
    return p.groupBy("extraction_id", "printed").agg(F.min_by("page_no", key).alias("best"), F.count("*").alias("copies"))


def page_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How similar each page is to the one before it in its text, and whether both bear the same printed number, as repeated scans do."""
    order = Window.partitionBy("extraction_id").orderBy("page_no")
    p = _pages(spark, sf_dir).withColumns({"folded": fold(F.col("page")), "printed": cleanup.printed_number(F.col("page"))})
    both = p.select("extraction_id", "page_no", "folded", F.lag("folded").over(order).alias("before"), F.coalesce(F.col("printed") == F.lag("printed").over(order), F.lit(False)).alias("same_number"))
    return both.filter("before is not null").select("extraction_id", "page_no", "same_number", seq_ratio(F.col("before"), F.col("folded")).alias("similarity"))


def _step(name: str):
    """One cleanup step on whole raw texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col("raw_text")
        if name == "inline_numbers":
            return _raw(spark, sf_dir).withColumn("kept", F.filter(split_lines(c), lambda x: ~cleanup.is_garbage_line(x))).select("extraction_id", F.array_join(cleanup.without_inline_numbers(F.col("kept")), "\n").alias("text"))
        steps = {
            "quotes": straight_quotes(c), "compose": cleanup.composed(c), "page_markers": F.regexp_replace(c, cleanup.PAGE_MARKER, ""), "invisibles": cleanup.strip_invisibles(c), "bars": F.regexp_replace(c, cleanup.ISOLATED_BAR, ""),
            "sections": F.regexp_replace(c, cleanup.EMBEDDED_SECTION, "\n\n"), "garbage_lines": F.array_join(F.filter(split_lines(c), lambda x: ~cleanup.is_garbage_line(x)), "\n"), "dehyphenate": cleanup.dehyphenate(c), "reflow": cleanup.reflow(c),
            "whitespace": cleanup.normalize_whitespace(c), "number_lines": F.array_join(F.filter(split_lines(c), lambda x: ~cleanup.is_page_number(x)), "\n"), "rstrip_lines": F.array_join(F.transform(split_lines(c), rstrip), "\n"),
        }
        return _raw(spark, sf_dir).select("extraction_id", steps[name].alias("text"))

    run.__name__ = f"step_{name}"
    return run


def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the rules that stand alone, on whole raw texts."""
    c = F.col("raw_text")
    return _raw(spark, sf_dir).filter("raw_text is not null").select(
        "extraction_id", F.length(c).alias("chars_in"), cleanup.count(c, cleanup.PAGE_MARKER).alias("page_markers"), (F.length(c) - F.length(cleanup.strip_invisibles(c))).alias("invisible"),
        cleanup.count(c, cleanup.LINE_HYPHEN).alias("hyphenations"), cleanup.count(c, r"\x{fffd}").alias("replacement_chars"), (F.size(F.split(c, "\f"))).alias("pages"), upper_ratio(c).alias("upper_ratio"), F.sha2(c, 256).alias("raw_sha256"),
    )


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.clean_text(_raw(spark, sf_dir), "raw_text").select("extraction_id", F.col("clean_text").alias("text"), "clean_stats.*", F.col("clean_warnings").alias("warnings"))


def clean_text_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.clean_text(_raw(spark, sf_dir), "raw_text", enhanced=True).select("extraction_id", F.col("clean_text").alias("text"), "clean_stats.*", F.col("clean_warnings").alias("warnings"))


def clean_and_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(structure.clean_and_structure(_raw(spark, sf_dir), "raw_text", enhanced=True), "raw_text").select("extraction_id", F.col("structured_text").alias("text"), "report")


def cleanup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered counters by engine, spelled one way."""
    c = table(spark, sf_dir, "cleanup_results").select("cleanup_id", "extraction_id", "stats").dropDuplicates(["cleanup_id"])
    e = table(spark, sf_dir, "extraction_results").select("extraction_id", F.lower(F.trim("engine")).alias("engine"))
    return c.join(e, "extraction_id").groupBy("engine").agg(F.count("*").alias("texts"), *(F.sum(f"stats.{k}").alias(k) for k in cleanup.STATS))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("cleanup_id", F.posexplode(structure.paragraphs(F.col("text"))).alias("para_no", "para"))


def paragraph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "documents").select("doc_id", F.posexplode(structure.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("para_no", "p"))).withColumn("f", fold(F.col("p")))
    c, f = F.col("p"), F.col("f")
    return p.select(
        "doc_id", "para_no", structure.is_toc_marker(f).alias("toc_marker"), structure.is_named(f).alias("named"), structure.is_colophon(f).alias("colophon"), structure.is_toc_entry(c).alias("toc_entry"), structure.is_toc_like(c).alias("toc_like"),
        c.rlike(structure.TOC_TAIL).alias("toc_tail"), structure.is_capitals(c, f).alias("capitals"), structure.numbered_level(c).cast("int").alias("numbered"), (c.endswith(".") & c.rlike(structure.NUMBERED)).alias("footnote"),
    )


def _blocks(spark: SparkSession, sf_dir: str, enhanced: bool = False) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))
    rows = docs.select("doc_id", F.posexplode(structure.structure_blocks(F.col("text"), enhanced=enhanced)).alias("para_no", "b"))
    return rows.select("doc_id", "para_no", "b.kind", "b.title_case", "b.fixed", "b.rendered")


def structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


def structure_blocks_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, True)


def structure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))
    return structure.apply_structure(docs, "text").select("doc_id", "structured_stats.*", F.sha2("structured_text", 256).alias("sha256"))


def review_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chunk_rows(_clean(spark, sf_dir), ["cleanup_id"], "text", 2000)


def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.manifest(_clean(spark, sf_dir).filter("text is not null"), "text", size=2000).drop("text")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "local_check_results").dropDuplicates(["check_id"]).join(_clean(spark, sf_dir), "cleanup_id")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).filter("text is not null").select("check_id", review.apply_suggestions(F.col("text"), F.col("matches")).alias("p")).select("check_id", "p.*")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered corrections against the cleaned text they were made for."""
    rows = _checks(spark, sf_dir).filter("text is not null").select("check_id", "text", F.coalesce("corrected_text", "text").alias("corrected"), F.when(F.col("corrected_text").isNotNull(), F.sha2("text", 256)).alias("sha"))
    return review.import_correction(rows, "text", "corrected", "sha").select("check_id", "changed", "source_hash_matches", (F.length("diff") > 0).alias("has_diff"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checks(spark, sf_dir).filter("text is not null and corrected_text is not null")
    return review.import_correction(rows.select("check_id", "text", "corrected_text"), "text", "corrected_text").filter("changed").select("check_id", "diff")


def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "local_check_results").dropDuplicates(["check_id"]).select("check_id", F.explode("matches").alias("m"))
    return m.groupBy(F.col("m.message").alias("message")).agg(F.count("*").alias("n"), F.count_if(F.size("m.replacements") > 0).alias("with_replacement"))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", review.to_plain_text(F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).alias("text"))


def card_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.extract_metadata(table(spark, sf_dir, "catalogue_cards"), "text", "filename").select("card_id", "meta_source", "meta_author", "meta_title", "meta_isbn", "meta_slug", "meta_confidence")


def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "catalogue_cards").filter("text is not null").select("card_id", metadata.parse_author(t).alias("author"), metadata.parse_title(t).alias("title"), metadata.parse_isbn(t).alias("isbn"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to take of every book on record: its range, clipped to its last page, and the folder they go to."""
    r = table(spark, sf_dir, "book_records").filter("pages.first >= 1 and pages.last >= pages.first").select("batch_id", "slug", "pages").distinct()
    spec = F.concat(F.col("pages.first").cast("string"), F.lit("-"), (F.col("pages.last") + 5).cast("string"))
    return r.select("batch_id", "slug", F.size(batch.resolve_pages(spec, F.col("pages.last"), F.lit(False))).alias("taken"), F.size(batch.resolve_pages(F.lit(None).cast("string"), F.col("pages.last"), F.col("pages.last") > 40)).alias("by_default"), batch.pages_slug(F.col("pages.first"), F.col("pages.last")).alias("folder"))


def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.latest(table(spark, sf_dir, "book_records"), "batch_id", "slug").groupBy("status").agg(F.count("*").alias("books"), F.max("recorded_at").alias("last_at"))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_totals(table(spark, sf_dir, "book_records").distinct())


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.completed_slugs(table(spark, sf_dir, "book_records"))


def to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.to_process(table(spark, sf_dir, "catalogue_cards").select("card_id", "slug"), table(spark, sf_dir, "book_records"))


def to_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.to_skip(table(spark, sf_dir, "catalogue_cards").select("card_id", "slug"), table(spark, sf_dir, "book_records"))


def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.collisions(table(spark, sf_dir, "book_records"))


def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per book, whether its native text is enough, by the characters of its extractions."""
    size = F.length(strip(F.col("raw_text")))
    rows = table(spark, sf_dir, "extraction_results").filter("slug is not null").groupBy("slug").agg(F.coalesce(F.sum(F.when(F.lower(F.trim("engine")) == "native", size)), F.lit(0)).alias("native_chars"))
    return rows.withColumn("engine", F.when(F.col("native_chars") >= 200, "native").otherwise("ocr"))


def glyph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of glyphs: the first pages' characters set in lines, with a margin line, notes and body."""
    p = _pages(spark, sf_dir).filter("page <> ''").select((F.col("extraction_id") * 1000 + F.col("page_no")).alias("page_id"), F.posexplode(split_lines(F.col("page"))).alias("line_no", "line"))
    size = F.when(F.col("line_no") % 7 == 6, 6.0).otherwise(10.0)
    g = p.select("page_id", "line_no", size.alias("size"), F.posexplode(F.split(F.concat("line", F.lit("\n")), "")).alias("i", "ch")).filter("ch <> ''")
    top = 800.0 - F.col("line_no") * 14.0
    glyphs = g.select("page_id", (F.col("line_no") * 100_000 + F.col("i")).alias("ord"), "ch", (60.0 + F.col("i") * 5.0).alias("left"), (65.0 + F.col("i") * 5.0).alias("right"), top.alias("top"), (top - F.col("size")).alias("bottom"))
    sizes = p.select("page_id").distinct().select("page_id", F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    return layout.assemble_pages(layout.classify_lines(layout.glyphs_to_lines(glyphs), sizes))


def native_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native page texts joined to books, broken words carried over page ends, paragraph breaks inferred."""
    p = _pages(spark, sf_dir).select(F.col("extraction_id").alias("book_id"), "page_no", F.col("page").alias("body"), F.lit("").alias("footnotes"))
    return layout.assemble_books(p)


def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractions cleaned as a file stream, each once."""
    source = f"{sf_dir}/extraction_results.parquet"
    like = spark.read.parquet(source)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"  # every call reads the table as it is now
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").parquet(source if "part-" in "".join(like.inputFiles()) else f"{sf_dir}/extraction_results.parque[t]")
    incremental.clean_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("extraction_id", F.col("structured_text").alias("text"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and characters by day of arrival and engine; the same aggregate that runs on a stream."""
    return incremental.arrivals(table(spark, sf_dir, "extraction_results"))


_STEPS = ["quotes", "compose", "page_markers", "number_lines", "invisibles", "bars", "sections", "garbage_lines", "inline_numbers", "dehyphenate", "reflow", "whitespace", "rstrip_lines"]
QUERIES = {
    f.__name__: f
    for f in (
        pages, lines, leading_pages, sample_pages, line_rules, trailing_numbers, folded_lines, running_headers, edge_headers, header_lines, body_lines, page_noise, best_pages, page_similarity, *map(_step, _STEPS), cleanup_counts, clean_text, clean_text_enhanced,
        clean_and_structure, cleanup_totals, paragraphs, paragraph_rules, structure_blocks, structure_blocks_enhanced, structure_stats, review_chunks, review_manifest, proposals, imports, diffs, match_totals, plain_text, card_metadata, card_fields, page_ranges,
        ledger_latest, ledger_totals, completed, to_process, to_skip, slug_collisions, engine_choice, glyph_layout, native_books, stream_clean, arrivals,
    )
}
