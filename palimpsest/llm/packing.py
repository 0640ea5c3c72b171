"""Filling containers of fixed capacity with items of varying length, by minimum bin slack.

Only lengths matter, and a container has at most ``capacity`` different ones: the corpus is reduced to
the number of items of each length, a table bounded by the capacity. On it bins are planned: the longest
item left opens a bin, and a subset-sum over the lengths left, on a bitset, finds the combination that
fills it best. A combination is used as often as its lengths allow, so there are no more of them than
lengths. The items then find their bin by their rank among those of their length.

An item longer than the capacity is cut into full containers and a rest; no other item is cut. Items
without tokens (null or empty text) lie in bin 0 and take no room. Ranks are counted in hashed buckets,
so a length that a third of all items have is many tasks. Repeated ids are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, salt_count


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best; ``lengths`` in descending order."""
    bits, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for x in lengths:
        if x > room:
            continue
        most, k = min(counts[x], room // x), 1
        while most > 0:  # multiplicities by doubling
            k = min(k, most)
            new = (bits | bits << (x * k)) & mask
            if new != bits:
                steps.append((x, k, bits))
                bits = new
            most -= k
            k *= 2
        if bits >> room & 1:
            break
    left, out = bits.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> left & 1:
            out[x] = out.get(x, 0) + k
            left -= x * k
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, items of each length), all items placed, the longest first."""
    counts = {x: n for x, n in histogram.items() if n > 0 and x > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        content = fullest([x for x in lengths if counts[x]], counts, capacity - first)
        counts[first] += 1
        content[first] = content.get(first, 0) + 1
        times = min(counts[x] // k for x, k in content.items())
        for x, k in content.items():
            counts[x] -= k * times
        out.append((times, content))
        if any(not counts[x] for x in content):
            lengths = [x for x in lengths if counts[x]]
    return out


def _seats(bins: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: ranks from which on a combination holds, its first bin, items a bin, and the bin's tokens."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    at = 1
    for times, content in bins:
        full = sum(x * k for x, k in content.items())
        for x, k in content.items():
            rows.setdefault(x, []).append((used.get(x, 0), at, k, full))
            used[x] = used.get(x, 0) + k * times
        at += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in rows.items()}


def pack(items: DataFrame, capacities: dict[str, int], *, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container, id, piece_no, first_token, tokens, bin_id, bin_tokens, bin_unused) of every piece of every item."""
    spark = items.sparkSession
    sizes = F.array(*(F.struct(F.lit(name).alias("container"), F.lit(int(c)).alias("capacity")) for name, c in sorted(capacities.items())))
    each = items.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size"), F.explode(sizes).alias("c")).select(id_col, "size", "c.*")
    pieces = each.select("container", "capacity", id_col, F.explode(F.expr("transform(sequence(0L, greatest(0L, (size - 1) div capacity)), i -> named_struct('piece_no', i, 'tokens', greatest(0L, least(size - i * capacity, capacity))))")).alias("p")).select("container", "capacity", id_col, "p.*")
    pieces = materialize(pieces, "pieces")
    histogram: dict[str, dict[int, int]] = {name: {} for name in capacities}
    for r in pieces.groupBy("container", "tokens").count().toLocalIterator():  # at most the sum of the capacities
        histogram[r.container][r.tokens] = r["count"]
    seats = spark.sparkContext.broadcast({name: _seats(plan(own, capacities[name]), capacities[name]) for name, own in histogram.items()})
    buckets = salt_count(sum(sum(own.values()) for own in histogram.values()))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(buckets)))
    key = ["container", "tokens", "bucket"]
    before = F.sum("n").over(Window.partitionBy("container", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = salted.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(before, F.lit(0)).alias("start"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(id_col, "piece_no")) - 1)
    placed = ranked.join(starts, key).select("container", id_col, "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), "tokens", "capacity", (F.col("rank") + F.col("start")).alias("rank"))

    def seat(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bins, full = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
            for (name, x), own in part.groupby(["container", "tokens"]).indices.items():
                if x:
                    lo, first, k, tokens = seats.value[name][x]
                    rank = part["rank"].to_numpy()[own]
                    j = np.searchsorted(lo, rank, side="right") - 1
                    bins[own], full[own] = first[j] + (rank - lo[j]) // k[j], tokens[j]
            yield part.drop(columns=["rank", "capacity"]).assign(bin_id=bins, bin_tokens=full, bin_unused=part["capacity"] - full)

    kind = dict(placed.dtypes)[id_col]
    return placed.mapInPandas(seat, f"container string, {id_col} {kind}, piece_no bigint, first_token bigint, tokens bigint, bin_id bigint, bin_tokens bigint, bin_unused bigint")


def unused(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Bins, tokens and unused room of each container, with a lower bound of the bins that any packing needs."""
    bins = packed.filter("bin_id > 0").groupBy("container", "bin_id").agg(F.sum("tokens").alias("tokens"), F.max("bin_unused").alias("left"))
    capacity = F.create_map(*(x for name, c in sorted(capacities.items()) for x in (F.lit(name), F.lit(int(c)))))
    total = bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("left").alias("unused_tokens"))
    return total.select("*", F.ceil(F.col("tokens") / capacity[F.col("container")]).alias("least_bins"))
