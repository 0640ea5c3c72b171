"""Mixing sources to target weights, as a curriculum over training time.

Every source has a weight schedule over t in [0, 1] whose integral is its share: it begins nearer to the
source's share of what there is and ends as far on the other side of its target, the weights of all
sources summing to one at any time. The total is the largest for which no source needs more than
``max_repeats`` of its tokens, or ``total`` if that is less. A source's tokens, in a hashed order, meet its
cumulative demand; inverting the integral of the schedule gives each copy of a document its position, and
the copies are range-sorted by position.

Sources without tokens cannot be used: their share goes to the others in proportion, and the report
shows it. Documents of no target source, without tokens, or of a null source are not chosen. Ties in the
order are broken by id. A source that holds a third of all documents is many hashed buckets, whose sums
are taken first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, salt_count

#: How far the schedules lean towards what there is, at the start; less where a weight would become negative.
LEAN = 0.5


def _demand(items: DataFrame, targets: list[dict], total: int | None) -> tuple[list[dict], float]:
    """Of each target source: tokens there are, share, lean and demand; and the total."""
    have = {r.source: r.tokens for r in items.join(F.broadcast(items.sparkSession.createDataFrame([(t["source"],) for t in targets], "source string")), "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # one row a target source
    usable = [t for t in targets if have.get(t["source"], 0) > 0 and t["target_share"] > 0 and t["max_repeats"] > 0]
    weight, stock = sum(t["target_share"] for t in usable), sum(have[t["source"]] for t in usable)
    out = []
    for t in targets:
        mine = have.get(t["source"], 0) or 0
        share = t["target_share"] / weight if t in usable else 0.0
        out.append(t | {"have": mine, "share": share, "toward": (mine / stock - share) if t in usable else 0.0})
    most = min((t["have"] * t["max_repeats"] / t["share"] for t in out if t["share"]), default=0.0)
    size = min(most, total) if total is not None else most
    lean = min([LEAN, *(t["share"] / abs(t["toward"]) for t in out if t["share"] and t["toward"])])
    for t in out:
        t["bend"], t["demand"] = lean * t["toward"], t["share"] * size
        t["full"] = min(t["max_repeats"], int(t["demand"] / t["have"] + 1e-9)) if t["share"] else 0
        t["rest"] = max(0.0, t["demand"] - t["full"] * t["have"]) if t["full"] < t["max_repeats"] else 0.0
    return out, size


def mix(documents: DataFrame, targets: list[dict], *, total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, copy, position) of every copy, range-sorted by position.

    ``documents`` has doc_id, source and n_tokens; ``targets`` has source, target_share and max_repeats.
    """
    spark = documents.sparkSession
    items = materialize(documents.filter("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens"), "sized")
    wanted, size = _demand(items, targets, total)
    plan = spark.createDataFrame([(t["source"], t["share"], t["bend"], float(t["have"]), t["full"], t["rest"]) for t in wanted if t["share"]], "source string, share double, bend double, have double, full int, rest double")
    buckets = salt_count(items.count())
    order = items.join(F.broadcast(plan), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.expr(f"shiftrightunsigned(h, 34) * {buckets} div {1 << 30}"))
    ahead = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = order.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).select("source", "bucket", F.coalesce(ahead, F.lit(0)).alias("start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = order.withColumn("inside", inside).join(starts, ["source", "bucket"])
    middle = F.col("start") + F.col("inside") - F.col("n_tokens") / 2
    chosen = placed.withColumn("middle", middle).withColumn("repeats", F.col("full") + (F.col("middle") <= F.col("rest")).cast("int")).filter("repeats > 0")
    copies = chosen.select("doc_id", "source", "n_tokens", "repeats", "share", "bend", F.explode(F.sequence(F.lit(1), "repeats")).alias("copy"), "middle", "have")
    c = (F.col("copy") - 1) * F.col("have") + F.col("middle")
    c = F.least(c / F.lit(max(size, 1.0)), F.col("share"))
    s, b = F.col("share") + F.col("bend"), F.col("bend")
    # share * t + bend * (t - t^2) = c, in the form that stays exact as bend goes to zero
    t = 2 * c / (s + F.sqrt(F.greatest(s * s - 4 * b * c, F.lit(0.0))))
    return copies.select("doc_id", "source", "n_tokens", "repeats", "copy", F.least(t, F.lit(1.0)).alias("position")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def shares(documents: DataFrame, targets: list[dict], *, total: int | None = None, seed: int = 0) -> DataFrame:
    """Target and reached share of every target source, with its tokens, documents and most repeats."""
    spark = documents.sparkSession
    mixed = mix(documents, targets, total=total, seed=seed)
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("repeats").alias("most_repeats"))
    frame = spark.createDataFrame([(t["source"], float(t["target_share"]), int(t["max_repeats"])) for t in targets], "source string, target_share double, max_repeats int")
    out = frame.join(used, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    return out.withColumn("reached_share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)))
