"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import table
from . import abuse, mixing, mojibake, near_duplicates, normal_form, packing, scan_noise, splitting, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mojibake.repaired(table(spark, sf_dir, "extraction_results"), "extraction_id", "raw_text", changed_only=True)
    return rows.select(F.col("id").alias("extraction_id")).distinct()


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its garbled sequences restored, how many were, how many characters are lost, and how."""
    return mojibake.repaired(table(spark, sf_dir, "extraction_results"), "extraction_id", "raw_text").withColumnRenamed("id", "extraction_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, sf_dir, "extraction_results"), "extraction_id", "raw_text", shingle=3, threshold=0.5, min_shingles=30)
    return pairs.select(F.col("id_a").alias("extraction_id_a"), F.col("id_b").alias("extraction_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every extraction that has a near-duplicate, named by its smallest id."""
    groups = near_duplicates.near_duplicate_groups(table(spark, sf_dir, "extraction_results"), "extraction_id", "raw_text", shingle=3, threshold=0.5, min_shingles=30)
    return groups.withColumnRenamed("id", "extraction_id")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(table(spark, sf_dir, "review_profiles"))  # three fixed rows


def _text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "cleanup_results").join(_profiles(spark, sf_dir), "profile")
    return splitting.split_texts(rows, "cleanup_id", "text", "max_chars", "overlap_chars")


def _match_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "local_check_results").join(_profiles(spark, sf_dir), "profile")
    return splitting.split_match_lists(rows, "check_id", "matches", "max_matches", "overlap_matches")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, kind: df.filter("piece_no > 0").select(F.lit(kind).alias("item_kind"), "item_id")
    return one(_text_pieces(spark, sf_dir), "text").unionByName(one(_match_pieces(spark, sf_dir), "matches")).distinct()


def p3_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized text; rows that were delivered twice give their pieces once."""
    return _text_pieces(spark, sf_dir).distinct()


def p3_match_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match_pieces(spark, sf_dir).distinct()


def _both(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    """The two tables whose texts problems 4 and 5 are about: kind, rows, id and text."""
    return [("extraction", table(spark, sf_dir, "extraction_results"), "extraction_id", "raw_text"), ("cleanup", table(spark, sf_dir, "cleanup_results"), "cleanup_id", "text")]


def _noisy(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
    one, two = (df.select(F.lit(kind).alias("record_kind"), F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("text"), "slug") for kind, df, key, text in _both(spark, sf_dir))
    return scan_noise.repaired(one.unionByName(two), ["record_kind", "record_id"], "text", "slug", **how)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir, noisy_only=True).select("record_kind", "record_id").distinct()


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in readable paragraphs, with counts of what was repaired."""
    return _noisy(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (normal_form.found(df, key, text).select(F.lit(kind).alias("record_kind"), "record_id") for kind, df, key, text in _both(spark, sf_dir))
    return one.unionByName(two).distinct()


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables in its one form, with counts of what was changed."""
    one, two = (normal_form.normalized(df.select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), F.col(text).alias("text")), "text").drop("text") for kind, df, key, text in _both(spark, sf_dir))
    return one.unionByName(two)


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r.container: r.capacity_tokens for r in table(spark, sf_dir, "container_sizes").collect()}  # three fixed rows


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every document, or of every piece of one, in each kind of container."""
    return packing.pack(tokens.token_counts(table(spark, sf_dir, "documents"), "text", "doc_id"), _capacities(spark, sf_dir))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unused(p6_containers(spark, sf_dir), _capacities(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every document placed, no bin over its capacity, only oversized documents cut, no fewer bins than the tokens need."""
    sizes, packed = _capacities(spark, sf_dir), p6_containers(spark, sf_dir)
    capacity = F.create_map(*(x for name, c in sorted(sizes.items()) for x in (F.lit(name), F.lit(int(c)))))[F.col("container")]
    bins = packed.filter("bin_id > 0").groupBy("container", "bin_id").agg(F.sum("tokens").alias("tokens"), F.max("bin_tokens").alias("told"))
    full = bins.groupBy("container").agg(F.count_if((F.col("tokens") > capacity) | (F.col("tokens") != F.col("told"))).alias("wrong_bins"), (F.count("*") >= F.ceil(F.sum("tokens") / F.max(capacity))).alias("bins_enough"))
    docs = packed.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    placed = docs.groupBy("container").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("cut_needlessly"))
    return placed.join(full, "container")


def _targets(spark: SparkSession, sf_dir: str) -> list[dict]:
    return [r.asDict() for r in table(spark, sf_dir, "mix_targets").orderBy("source").collect()]  # thirteen fixed rows


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every chosen document, in training order."""
    return mixing.mix(tokens.token_counts(table(spark, sf_dir, "documents"), "text", "doc_id", "source"), _targets(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(tokens.token_counts(table(spark, sf_dir, "documents"), "text", "doc_id", "source"), _targets(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source with a target, its share among the sources that have documents, and whether the mixture keeps share and repeats.

    A share is reached if the source's tokens lie within two documents, the largest there is, of it: documents are whole.
    """
    mixed = p7_mix(spark, sf_dir)
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"), F.max("repeats").alias("repeats"))
    rows = table(spark, sf_dir, "mix_targets").join(F.broadcast(used), "source", "left").na.fill(0, ["tokens", "largest", "repeats"])  # thirteen fixed rows
    every = Window.partitionBy()
    share = F.when(F.col("tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every)).otherwise(0.0)
    off = F.abs(F.col("tokens") - share * F.sum("tokens").over(every))
    return rows.select("source", F.round(share, 6).alias("share"), (off <= 2 * F.max("largest").over(every)).alias("reached"), (F.col("repeats") <= F.col("max_repeats")).alias("repeats_kept"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, windows and flag of every document."""
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"), "doc_id", "source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).filter("abusive").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents, their rate and the mean score of every source."""
    scores = p8_scores(spark, sf_dir)
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("flagged"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_texts, p2_found, p2_groups, p3_found, p3_text_pieces, p3_match_pieces, p4_found, p4_texts, p5_found, p5_texts, p6_containers, p6_unused, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_scores, p8_rates)}

_P3 = """
select 'text' as item_kind, cleanup_id as item_id from cleanup_results join review_profiles using (profile) where length(text) > max_chars
union
select 'matches', check_id from local_check_results join review_profiles using (profile) where len(matches) > max_matches
"""
_P2 = r"""
with w as (select extraction_id as id, list_filter(regexp_split_to_array(lower(raw_text), '[ \t\r\n\f]+'), lambda x: x <> '') as ws from extraction_results where raw_text is not null),
t as (select id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as ts from w where len(ws) >= 3),
s as (select id, len(ts) as n, unnest(ts) as x from t where len(ts) >= 30),
c as (select a.id as ia, b.id as ib, a.n as na, b.n as nb, count(*) as both_n from s a join s b on a.x = b.x and a.id < b.id group by all)
select ia as extraction_id_a, ib as extraction_id_b from c where both_n >= 0.5 * (na + nb - both_n)
"""
_P6 = "select container, (select count(distinct doc_id) from documents) as documents, 0 as cut_needlessly, 0 as wrong_bins, true as bins_enough from container_sizes"
_P7 = """
with d as (select distinct source from documents where length(text) > 0)
select source, round(case when d.source is null then 0 else target_share / sum(target_share) filter (d.source is not null) over () end, 6) as share, true as reached, true as repeats_kept from mix_targets left join d using (source)
"""
SQL: dict[str, str] = {"p2_found": _P2, "p3_found": _P3, "p6_checks": _P6, "p7_checks": _P7}
