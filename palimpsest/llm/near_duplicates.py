"""Near-duplicate records: SetSketch registers, banded, jointly estimated by likelihood, then verified.

The words of a text are its lower-cased form cut at white space; its set holds the distinct runs of
``shingle`` consecutive words. Two texts are near-duplicates when the Jaccard similarity of their
sets reaches ``threshold`` and each set has at least ``min_shingles`` members.

Plan: rows whose shingle sets are equal collapse to one representative first, so exact copies cost
one sketch. Each representative keeps ``M`` SetSketch registers (truncated logarithms of the minima of
exponential variables, mergeable by maximum). Bands of ``ROWS`` registers become 64-bit keys;
representatives that share a key meet in a join. Texts that only share phrases meet by chance, more of them with the square
of the rows, so every key brings two bits of ``SIGNED`` registers along, and a pair whose bits differ too often never
leaves the join. The joint maximum-likelihood estimate over the counts of smaller, equal and larger
registers, all ``M`` of them, removes further ones; exact sets decide the rest.

Nulls and empty texts have no shingles and take part in no pair. Repeated ids count once. Any
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, broadcast_if_small, materialize
from .batches import slices

#: SetSketch parameters: registers, base, rate, and the largest register value.
M, BASE, RATE, Q = 192, 1.001, 20.0, 62_000
#: Registers in a band; a pair at similarity 0.5 shares none of the M / ROWS bands in 0.02 % of cases.
ROWS = 3
#: Standard errors that an estimate may lie below the threshold before its pair is dropped unverified.
SLACK = 5.0
#: Registers whose two lowest bits go with every band key; bands joined at once, whose keys lie on disk at the same time.
SIGNED, BANDS_A_ROUND = 128, 16

_BITS = [f"bits_{k}" for k in range(SIGNED // 32)]
_CUT = re.compile(r"[ \t\r\n\f]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    return [w for w in _CUT.split(text.lower()) if w]


class Shingler:
    """Hashes of word runs, over many texts at once; word hashes are kept between batches."""

    def __init__(self, shingle: int) -> None:
        self.shingle = shingle
        self.ids: dict[str, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)

    def _word_hashes(self, flat: list[str]) -> np.ndarray:
        import xxhash

        if len(self.ids) > 2_000_000:
            self.ids, self.hashes = {}, np.zeros(0, dtype=np.uint64)
        new = set(flat).difference(self.ids)
        if new:
            first = len(self.ids)
            self.ids.update((w, first + k) for k, w in enumerate(new))
            fresh = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new), dtype=np.uint64, count=len(new))
            self.hashes = np.concatenate([self.hashes, fresh])
        return self.hashes[np.fromiter(map(self.ids.__getitem__, flat), dtype=np.int64, count=len(flat))]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All distinct shingle hashes, text after text, and where each text's begin."""
        split = [words(t) if t else [] for t in texts]
        counts = np.array([len(s) for s in split], dtype=np.int64)
        flat = [w for s in split for w in s]
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        k = self.shingle
        if len(flat) < k:
            return np.zeros(0, dtype=np.uint64), starts
        h = self._word_hashes(flat)
        run = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            run = _mix(run * _GOLD + h[j : len(h) - k + 1 + j])
        owner = np.repeat(np.arange(len(texts)), counts)
        inside = owner[: len(run)] == owner[k - 1 :]
        run, owner = run[inside], owner[: len(inside)][inside]
        order = np.lexsort((run, owner))
        run, owner = run[order], owner[order]
        keep = np.ones(len(run), dtype=bool)
        keep[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
        run, owner = run[keep], owner[keep]
        starts[1:] = np.cumsum(np.bincount(owner, minlength=len(texts)))
        return run, starts


def registers(run: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of every non-empty set, as a (sets, M) array of uint16."""
    first, last = starts[:-1], starts[1:]
    full = last > first
    at = first[full]
    low = np.empty((len(at), M), dtype=np.uint64)
    lo, hi = (run & np.uint64(0xFFFFFFFF)).astype(np.uint32), (run >> np.uint64(32)).astype(np.uint32)
    seeds = _mix(np.arange(1, 2 * M + 1, dtype=np.uint64) * _GOLD).astype(np.uint32) | np.uint32(1)
    buf = np.empty(len(run), dtype=np.uint32)
    tmp = np.empty(len(run), dtype=np.uint32)
    for i in range(M):
        np.multiply(lo, seeds[2 * i], out=buf)
        np.right_shift(buf, np.uint32(15), out=tmp)
        np.bitwise_xor(buf, tmp, out=buf)
        np.bitwise_xor(buf, hi, out=buf)
        np.multiply(buf, seeds[2 * i + 1], out=buf)
        low[:, i] = np.minimum.reduceat(buf, at)
    u = (low.astype(np.float64) + 0.5) / 2**32
    x = -np.log1p(-u) / RATE
    out = np.zeros((len(starts) - 1, M), dtype=np.uint16)
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)
    return out


def signatures(regs: np.ndarray) -> np.ndarray:
    """The two lowest bits of the first ``SIGNED`` registers, as (sets, SIGNED / 32) words: all low bits, then all high bits."""
    low = regs[:, :SIGNED]
    return np.concatenate([np.packbits((low >> k & 1).astype(np.uint8), axis=1) for k in (0, 1)], axis=1).view(np.int64)


def most_different(threshold: float) -> int:
    """Signed registers that may differ in their bits at ``threshold``: unequal registers do in three of four cases."""
    p = 0.75 * (1 - threshold)
    return int(SIGNED * p + SLACK * np.sqrt(SIGNED * p * (1 - p)))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def jaccard_by_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 60) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of sketched sets of known sizes, row by row."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def slope(j: np.ndarray) -> np.ndarray:
        total = 0.0
        e = 1e-6
        for sign in (1, -1):
            x, y = _p(u - v * (j + sign * e)), _p(v - u * (j + sign * e))
            ll = above * np.log(np.maximum(x, 1e-300)) + below * np.log(np.maximum(y, 1e-300)) + equal * np.log(np.maximum(1 - x - y, 1e-300))
            total = total + sign * ll
        return total

    for _ in range(steps // 2):  # the likelihood has one peak: bisect on its slope
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def sketch(df: DataFrame, id_col: str, text_col: str, *, shingle: int, min_shingles: int) -> DataFrame:
    """(id, n, set_hash, regs, bits) of every row with at least ``min_shingles`` distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in slices([t or "" for t in texts]):
                hashes, starts = shingler(texts[lo:hi])
                n = np.diff(starts)
                big = np.flatnonzero(n >= min_shingles)
                if not len(big):
                    continue
                inside = np.repeat(n >= min_shingles, n)
                hashes = hashes[inside]
                at = np.zeros(len(big) + 1, dtype=np.int64)
                np.cumsum(n[big], out=at[1:])
                regs = registers(hashes, at)
                whole = np.add.reduceat(_mix(hashes), at[:-1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][big], type=pa.int64()), pa.array(n[big].astype(np.int32)), pa.array(whole), pa.array([r.tobytes() for r in regs], type=pa.binary()), *map(pa.array, signatures(regs).T.copy())],
                    names=["id", "n", "set_hash", "regs", *_BITS],
                )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null and length(text) > 0")
    return rows.mapInArrow(run, "id bigint, n int, set_hash bigint, regs binary" + "".join(f", {c} bigint" for c in _BITS))


#: Band keys, sets of registers and texts that one task of a join should hold, about; more rows get more tasks.
KEYS_A_TASK, REGISTERS_A_TASK, TEXTS_A_TASK = 400_000, 20_000, 4_000
#: Exact copies in a block; pairs of copies are made block against block, so that no task holds more.
COPIES_A_BLOCK = 1_000


def class_pairs(df: DataFrame, id_col: str, text_col: str, tables: Scratch, *, shingle: int = 5, threshold: float = 0.8, min_shingles: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs (rep_a, rep_b, jaccard) of different shingle sets that reach ``threshold``, and (id, rep, copies) of all rows.

    Every set is named by the smallest id that has it. Joins are sized by counted rows; a band key that very many sets
    share is divided by the adaptive skew join, since all its shuffles are Spark's own.
    """
    rows = tables.table(sketch(df, id_col, text_col, shingle=shingle, min_shingles=min_shingles), "sketch")
    # equal sets (64-bit sum of mixed hashes, and equal size) collapse to their smallest id
    classes = tables.table(rows.groupBy("set_hash", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    n_rows, n_sets, some = rows.count(), classes.count(), not classes.filter("copies > 1").isEmpty()
    if some:
        members = tables.table(rows.select("id", "set_hash", "n").join(classes, ["set_hash", "n"]).select("id", "rep", "copies"), "members", -(-n_rows // KEYS_A_TASK))
        single = members.filter("copies > 1 and id <> rep").select("id")
        reps = tables.table(rows.join(broadcast_if_small(single, n_rows - n_sets), "id", "left_anti"), "reps", -(-n_rows // REGISTERS_A_TASK))
        tables.drop("sketch")
    else:
        members, reps = rows.select("id", F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("copies")), rows
    found = tables.table(_met(tables, reps, n_sets, threshold).distinct(), "found")
    tables.drop("round")
    # only sets with a candidate bring their registers along
    ends = _ends(tables, found, "found_ends")
    n_found, n_ends = found.count(), ends.count()
    known = reps.select("id", "n", "regs").join(broadcast_if_small(ends, n_ends), "id", "left_semi")
    side = lambda x: known.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "regs")))
    sketched = found.join(side("a"), "id_a").join(side("b"), "id_b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        error = np.sqrt(threshold * (1 - threshold) / M)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            regs = [np.frombuffer(b"".join(col[f"regs_{x}"].to_pylist()), dtype=np.uint16).reshape(-1, M) for x in "ab"]
            sizes = [col[f"n_{x}"].to_numpy(zero_copy_only=False).astype(float) for x in "ab"]
            keep = pa.array(jaccard_by_likelihood(*regs, *sizes) >= threshold - SLACK * error)
            yield pa.RecordBatch.from_arrays([col["id_a"].filter(keep), col["id_b"].filter(keep)], names=["id_a", "id_b"])

    likely = tables.table(sketched.mapInArrow(estimate, "id_a bigint, id_b bigint"), "likely", -(-(n_found + n_ends) // REGISTERS_A_TASK))
    for name in ("reps", "found", "found_ends") if some else ("found", "found_ends"):
        tables.drop(name)
    ends = _ends(tables, likely, "ends")
    n_likely, n_ends = likely.count(), ends.count()
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    needed = texts.join(broadcast_if_small(ends, n_ends), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    whole = likely.join(needed.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(needed.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[tuple[int, int, float]] = []
            sets: dict[str, set] = {}

            def of(t: str) -> set:
                if t not in sets:
                    w = words(t)
                    sets[t] = set(zip(*(w[j:] for j in range(shingle))))
                return sets[t]

            for i, j, x, y in zip(*(c.to_pylist() for c in (batch.column(k) for k in (batch.schema.get_field_index(n) for n in ("id_a", "id_b", "text_a", "text_b"))))):
                p, q = of(x), of(y)
                both = len(p & q)
                if both >= threshold * (len(p) + len(q) - both):
                    keep.append((i, j, both / (len(p) + len(q) - both)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64()), pa.array([k[2] for k in keep], pa.float64())], names=["rep_a", "rep_b", "jaccard"]
            )

    return tables.table(whole.mapInArrow(verify, "rep_a bigint, rep_b bigint, jaccard double"), "between", -(-(n_likely + n_ends) // TEXTS_A_TASK)), members


def _met(tables: Scratch, reps: DataFrame, n_sets: int, threshold: float) -> DataFrame:
    """(id_a, id_b) of the sets that share a band key and whose signed bits may belong to ``threshold``; a pair once a round of bands."""
    bands, half = M // ROWS, len(_BITS) // 2
    differ = " + ".join(f"bit_count((a.bits_{k} ^ b.bits_{k}) | (a.bits_{k + half} ^ b.bits_{k + half}))" for k in range(half))
    rounds = []
    for first in range(0, bands, BANDS_A_ROUND):
        last = min(first + BANDS_A_ROUND, bands) - 1
        key = f"transform(sequence({first}, {last}), b -> xxhash64(b, substring(regs, b * {2 * ROWS} + 1, {2 * ROWS})))"
        keyed = reps.select("id", "n", *_BITS, F.explode(F.expr(key)).alias("key"))
        both = keyed.alias("a").join(keyed.alias("b"), F.expr(f"a.key = b.key and a.id < b.id and a.n >= {threshold} * b.n and b.n >= {threshold} * a.n and {differ} <= {most_different(threshold)}"))
        rounds.append(tables.table(both.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct(), "round", -(-n_sets * (last - first + 1) // KEYS_A_TASK)))
    return reduce(DataFrame.unionByName, rounds)


def _ends(tables: Scratch, pairs: DataFrame, label: str) -> DataFrame:
    """The ids of pairs, once each."""
    return tables.table(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), label)


def copy_pairs(members: DataFrame) -> DataFrame:
    """(x, y): every two rows of one shingle set; a set of many copies is joined block against block."""
    many = members.filter("copies > 1").select("id", "rep", F.ceil(F.col("copies") / COPIES_A_BLOCK).cast("int").alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # the pair of blocks (low, high) is one group of the join; each row belongs to a group with every block
    sides = many.select("id", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("id", "rep", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    a, b = sides.alias("a"), sides.alias("b")
    return a.join(b, F.expr("a.rep = b.rep and a.low = b.low and a.high = b.high and a.id < b.id and (a.own <> b.own or a.low = a.high)")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8, min_shingles: int = 1) -> DataFrame:
    """Every pair (id_a < id_b) of rows whose shingle sets reach ``threshold``, with its exact Jaccard."""
    with Scratch(df.sparkSession) as tables:
        between, members = class_pairs(df, id_col, text_col, tables, shingle=shingle, threshold=threshold, min_shingles=min_shingles)
        many = members.filter("copies > 1")
        m = lambda x: many.select(F.col("rep").alias(f"rep_{x}"), F.col("id").alias(f"id_{x}"))
        across = between.join(m("a"), "rep_a", "left").join(m("b"), "rep_b", "left").select(F.coalesce("id_a", "rep_a").alias("x"), F.coalesce("id_b", "rep_b").alias("y"), "jaccard")
        both = across.unionByName(copy_pairs(members).withColumn("jaccard", F.lit(1.0)))
        pairs = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")
        # a pair comes twice only where an id does: the pairs, which may be many more than the rows, are shuffled only then
        once = members.groupBy("id").count().filter("count > 1").isEmpty()
        return materialize(pairs if once else pairs.groupBy("id_a", "id_b").agg(F.max("jaccard").alias("jaccard")), "pairs")


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, threshold: float = 0.8, min_shingles: int = 1) -> DataFrame:
    """(id, group_id) of every row with a near-duplicate or copy; pairs lie between shingle sets only, copies follow their set."""
    with Scratch(df.sparkSession) as tables:
        between, members = class_pairs(df, id_col, text_col, tables, shingle=shingle, threshold=threshold, min_shingles=min_shingles)
        groups = duplicate_groups(between.select(F.col("rep_a").alias("id_a"), F.col("rep_b").alias("id_b"))).withColumnRenamed("id", "rep")
        named = members.join(groups, "rep", "left").filter("group_id is not null or copies > 1")
        # a set's representative is its smallest id, so the smallest representative is the smallest id of the group
        return materialize(named.groupBy("id").agg(F.min(F.coalesce("group_id", "rep")).alias("group_id")), "groups")


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id): connected groups of near-duplicates, by label passing with pointer jumping.

    ``group_id`` is the smallest id of the group. A round gives all rows of one label the smallest label beside any
    of them, so a long chain takes few rounds; rounds end when nothing moves. Each round's table is written to
    the shared folder.
    """
    edges = materialize(pairs.selectExpr("id_a as u", "id_b as v").unionByName(pairs.selectExpr("id_b as u", "id_a as v")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.id).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.u, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("mid"))
        hooks = step.groupBy("label").agg(F.min("mid").alias("hook"))
        hooked = materialize(labels.join(hooks, "label").select("id", "label", "hook"), "hooked")
        jump = hooked.select(F.col("id").alias("hook"), F.col("hook").alias("far"))
        new = materialize(hooked.join(jump, "hook", "left").select("id", F.least("hook", F.coalesce("far", "hook")).alias("label"), (F.least("hook", F.coalesce("far", "hook")) < F.col("label")).alias("moved")), "labels")
        labels = new.select("id", "label")
        if new.filter("moved").isEmpty():
            return labels.select("id", F.col("label").alias("group_id"))
