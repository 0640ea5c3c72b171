"""Splitting oversized items at natural boundaries.

A text is a run of bytes, in a file or in a table's cell, and is looked at byte range by byte range. Workers detect the
boundaries of a range with a halo of ``LOOKBACK`` characters around it, so a range's table of boundaries is
the same as the whole text's. Tables are stitched by prefix sums of the ranges' lengths in characters, pieces are
chosen on the tables alone, and emitted by offset: only a piece's own ranges are decoded. Cells lie in a worker anyway, so
their ranges follow each other there. Files are never loaded whole: ranges and segments of ``SEGMENT`` ranges are
tasks. Where a segment's first piece starts depends on the segments before it; all start at a guess, hand on where their last piece
ends, and those that were given another start than they took are done again until none is. The pieces are the same
for any size of ranges and segments.

A piece starts ``overlap`` characters before the end of the one before it and holds at most ``limit``
characters, the overlap included. Its end is the last paragraph end in the second half of what it may
hold, else the last sentence end there, else line end, else word end, else any of these after the
overlap, else the limit itself. White space stays with the piece it ends, so that the pieces without
their overlaps are the text.

Lists of matches are put in order of (offset, length, position) and cut where no match reaches over the
cut, if such a place exists within the limit. Offsets stay those of the whole text.

Null or empty texts and lists, and items up to the limit, are no pieces: only oversized items come out.
Rows whose limit is null are left alone. An overlap of the limit or more counts as the limit less one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, materialize

PARAGRAPH, SENTENCE, LINE, WORD, HARD = range(5)
KIND_NAMES = ["paragraph", "sentence", "line", "word", "limit"]
#: Characters before a position that decide which boundary it is.
LOOKBACK = 256
#: Bytes of one range of a file and of a cell, and ranges of one segment of a file.
RANGE, CELL_RANGE, SEGMENT = 1 << 20, 1 << 13, 16

_GAP = re.compile(r"\s+")
_CLOSERS = "\"'”’»)]}"


def boundaries(text: str, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions p in (lo, hi] after which a cut is natural, and their kinds, from text[lo - LOOKBACK:hi + 1]."""
    hi = len(text) if hi is None else hi
    at, kinds = [], []
    for m in _GAP.finditer(text, max(0, lo - LOOKBACK)):
        p = m.end()
        if p > hi:
            break
        if p <= lo or p >= len(text):
            continue
        floor = max(0, p - LOOKBACK)
        run = text[max(m.start(), floor) : p]
        breaks = run.count("\n") + run.count("\f") * 2 + run.count(" ") * 2 or run.count("\r")
        at.append(p)
        if breaks >= 2:
            kinds.append(PARAGRAPH)
            continue
        k = m.start() - 1
        while k >= floor and text[k] in _CLOSERS:
            k -= 1
        kinds.append(SENTENCE if k >= floor and text[k] in ".!?…" else LINE if breaks else WORD)
    return np.array(at, dtype=np.int64), np.array(kinds, dtype=np.int8)


def chain(at: np.ndarray, kinds: np.ndarray, length: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, kind of the end) of [0, length) chosen on sorted boundaries alone."""
    return chain_until(at, kinds, length, limit, overlap, 0, length)[0]


def chain_until(at: np.ndarray, kinds: np.ndarray, length: int, limit: int, overlap: int, start: int, stop: int) -> tuple[list[tuple[int, int, int]], int]:
    """The pieces from ``start`` on that start before ``stop``, and where the next one starts (``length`` if there is none)."""
    overlap = max(0, min(overlap, limit - 1))
    by = [at[kinds == k] for k in range(HARD)]
    out: list[tuple[int, int, int]] = []
    while start < stop:
        if length - start <= limit:
            out.append((start, length, PARAGRAPH))
            return out, length
        top, end, kind = start + limit, start + limit, HARD
        done = start + (overlap if start else 0)
        for least in (max(done + 1, start + limit // 2), done + 1):
            for k, own in enumerate(by):
                j = np.searchsorted(own, top, side="right") - 1
                if j >= 0 and own[j] >= least:
                    end, kind = int(own[j]), k
                    break
            if kind != HARD:
                break
        out.append((start, end, kind))
        start = max(end - overlap, start + 1)
    return out, start


def _char_start(raw: bytes | memoryview, p: int) -> int:
    """The first position from p on where a UTF-8 character begins."""
    while p < len(raw) and raw[p] & 0xC0 == 0x80:
        p += 1
    return p


def range_table(read: Callable[[int, int], bytes | memoryview], lo: int, hi: int, size: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of the characters that begin in bytes [lo, hi): the byte of the first, how many they are, and the boundaries among their starts.

    Boundaries are given by their character's number in the range and their kind.
    """
    halo = LOOKBACK * 4
    first = max(0, lo - halo - 4)
    raw = read(first, min(size, hi + halo))
    begin = 0 if first == 0 else _char_start(raw, 1)
    own, past = _char_start(raw, lo - first), _char_start(raw, min(hi, size) - first)
    head = str(raw[begin:own], "utf-8", "replace")
    body = str(raw[own:past], "utf-8", "replace")
    tail = str(raw[past:], "utf-8", "replace")
    # a boundary before the first character of the next range belongs to that range
    at, kinds = boundaries(head + body + tail, len(head) - 1, len(head) + len(body) - 1)
    keep = at >= len(head)
    return first + own, len(body), at[keep] - len(head), kinds[keep]


def stitched(tables: list[tuple[np.ndarray, np.ndarray]], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One table of boundaries from those of consecutive ranges and the characters before each."""
    return np.concatenate([at + n for (at, _), n in zip(tables, before)]), np.concatenate([kinds for _, kinds in tables])


def split_cell(text: bytes | memoryview, limit: int, overlap: int, *, range_bytes: int = CELL_RANGE) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, kind, text) of one cell's UTF-8 bytes, by ranges."""
    size = len(text)
    ranges = [range_table(lambda a, b: text[a:b], lo, min(size, lo + range_bytes), size) for lo in range(0, size, range_bytes)]
    ends = np.cumsum([r[1] for r in ranges])
    total, before = int(ends[-1]) if ranges else 0, ends - [r[1] for r in ranges]
    if total <= limit:
        return []
    out = []
    for a, b, kind in chain(*stitched([r[2:] for r in ranges], before), total, limit, overlap):
        first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left")
        past = ranges[last + 1][0] if last + 1 < len(ranges) else size
        own = str(text[ranges[first][0] : past], "utf-8", "replace")
        out.append((a, b, kind, own[a - before[first] : b - before[first]]))
    return out


def split_text(text: str, limit: int, overlap: int, *, range_bytes: int = CELL_RANGE) -> list[tuple[int, int, int]]:
    """Pieces (start, end, kind) of a text."""
    return [p[:3] for p in split_cell(text.encode("utf-8", "surrogatepass"), limit, overlap, range_bytes=range_bytes)]


def split_texts(df: DataFrame, id_col: str, text_col: str, limit_col: str, overlap_col: str) -> DataFrame:
    """(item_id, piece_no, start, end, cut, overlap, piece) of every text longer than its limit.

    Only oversized texts leave the JVM; their bytes are read where Arrow put them.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"), F.col(limit_col).cast("int").alias("cap"), F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)).alias("lap")).filter("length(text) > cap and cap > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, caps, laps = (batch.column(k) for k in range(4))
            out: list[tuple] = []
            for k in range(batch.num_rows):
                last = 0
                pieces = split_cell(memoryview(texts[k].as_buffer()), caps[k].as_py(), laps[k].as_py())
                for n, (a, b, kind, piece) in enumerate(pieces):
                    out.append((ids[k].as_py(), n, a, b, KIND_NAMES[kind] if n + 1 < len(pieces) else "end", max(0, last - a), piece))
                    last = b
            columns = list(zip(*out)) if out else [[] for _ in PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, PIECE.values())], names=list(PIECE))

    return rows.mapInArrow(run, "item_id bigint, piece_no int, start bigint, end bigint, cut string, overlap int, piece string")


PIECE = {"item_id": pa.int64(), "piece_no": pa.int32(), "start": pa.int64(), "end": pa.int64(), "cut": pa.string(), "overlap": pa.int32(), "piece": pa.string()}


def split_matches(offsets: list[tuple[int | None, int | None]], limit: int, overlap: int) -> tuple[list[int], list[tuple[int, int, bool]]]:
    """Order of the matches, and pieces (first, past the last, whether a match reaches over the end) in that order."""
    far = 1 << 62
    order = sorted(range(len(offsets)), key=lambda i: (*(far if x is None else x for x in offsets[i]), i))
    n = len(order)
    if n <= limit:
        return order, []
    overlap = max(0, min(overlap, limit - 1))
    clear, reach = [True] * (n + 1), -1
    for k, i in enumerate(order):
        o, size = offsets[i]
        clear[k] = o is None or reach <= o
        if o is not None:
            reach = max(reach, o + max(size or 0, 0))
    out: list[tuple[int, int, bool]] = []
    start = 0
    while n - start > limit:
        done = start + (overlap if out else 0)
        end = next((k for k in range(start + limit, done, -1) if clear[k]), start + limit)
        out.append((start, end, not clear[end]))
        start = max(end - overlap, start + 1)
    out.append((start, n, False))
    return order, out


def split_match_lists(df: DataFrame, id_col: str, matches_col: str, limit_col: str, overlap_col: str) -> DataFrame:
    """(item_id, piece_no, first, past, cuts_a_match, overlap, order) of every list longer than its limit.

    ``order`` holds the positions in the list, from 0, of the piece's matches; only offsets and lengths leave the JVM.
    """
    rows = df.filter(F.size(matches_col) > F.col(limit_col)).filter(F.col(limit_col) > 0).select(
        F.col(id_col).alias("item_id"), F.transform(matches_col, lambda m: m["offset"]).alias("offsets"), F.transform(matches_col, lambda m: m["length"]).alias("lengths"),
        F.col(limit_col).cast("int").alias("cap"), F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)).alias("lap"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for item, offsets, lengths, cap, lap in part.itertuples(index=False, name=None):
                own = [tuple(None if x is None or x != x else int(x) for x in pair) for pair in zip(offsets, lengths)]
                order, pieces = split_matches(own, int(cap), int(lap))
                last = 0
                for n, (a, b, over) in enumerate(pieces):
                    out.append((item, n, a, b, over, max(0, last - a), order[a:b]))
                    last = b
            yield pd.DataFrame(out, columns=["item_id", "piece_no", "first", "past", "cuts_a_match", "overlap", "order"])

    return rows.mapInPandas(run, "item_id bigint, piece_no int, first int, past int, cuts_a_match boolean, overlap int, order array<int>")


# --- files larger than memory ------------------------------------------------------------------


def _read(path: str, lo: int, hi: int) -> bytes:
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with files.open_input_file(inner) as f:
        f.seek(lo)
        return f.read(hi - lo)


def split_files(spark: SparkSession, files: list[tuple[str, int]], limit: int, overlap: int, *, range_bytes: int = RANGE, segment: int = SEGMENT) -> DataFrame:
    """(path, start, end, first_byte, past_byte, cut, piece) of UTF-8 files of known sizes, by byte range.

    ``files`` is a listing: paths and sizes in bytes. Sizes of 0 give no piece; a file up to the limit is one piece. Workers read ranges with
    halos, then pieces by offset; no worker holds more than a segment's tables of boundaries and those of a limit beyond.
    """
    n_ranges = sum(-(-int(s) // range_bytes) for _, s in files)
    listing = spark.createDataFrame([(p, int(s)) for p, s in files if s > 0], "path string, size bigint")
    ranges = listing.select("path", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {range_bytes}L)")).alias("no")).repartition(max(1, min(n_ranges, 100_000)), "path", "no")

    def table(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, size, no in part.itertuples(index=False, name=None):
                first, n, at, kinds = range_table(lambda a, b, path=path: _read(path, a, b), no * range_bytes, min(size, (no + 1) * range_bytes), size)
                yield pd.DataFrame({"path": [path], "size": [size], "no": [no], "byte": [first], "chars": [n], "at": [at], "kind": [kinds.astype(np.int32)]})

    with Scratch(spark) as tables:
        found = tables.table(ranges.mapInPandas(table, "path string, size bigint, no bigint, byte bigint, chars bigint, at array<bigint>, kind array<int>"), "ranges")
        order = Window.partitionBy("path").orderBy("no")
        everything = Window.partitionBy("path")
        # prefix sums over ranges, of which a file of a terabyte has a million: three numbers each
        lengths = found.select("path", "no", "chars", "byte").select("path", "no", (F.sum("chars").over(order) - F.col("chars")).alias("before"), F.sum("chars").over(everything).alias("total"), F.coalesce(F.lead("byte").over(order), F.lit(-1)).alias("past"))
        placed = tables.table(found.join(lengths, ["path", "no"]), "placed")
        # a segment sees the ranges that its last piece may reach into
        look = -(-limit * 4 // range_bytes) + 1
        near = placed.select("*", F.explode(F.expr(f"sequence(greatest(0L, (no - {look}L) div {segment}L), no div {segment}L)")).alias("segment"))
        starts = placed.filter(f"no % {segment} = 0").select("path", F.expr(f"no div {segment}").alias("segment"), F.col("before").alias("start"))

        def pieces(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return _segment_pieces(key, part, limit, overlap, segment)

        def done(given: DataFrame) -> DataFrame:
            return near.join(given, ["path", "segment"]).groupBy("path", "segment").applyInPandas(pieces, _PIECES)

        # all segments from a guess, then those whose start was another, until none is
        given, known = tables.table(starts, "given"), None
        while True:
            fresh = tables.table(done(given), "pieces")
            known = fresh if known is None else tables.table(known.join(given.select("path", "segment"), ["path", "segment"], "left_anti").unionByName(fresh), "pieces")
            ends = known.filter("start is null").select("path", "segment", F.col("end").alias("own"), F.col("given"))
            after = ends.select("path", (F.col("segment") + 1).alias("segment"), F.col("own").alias("start"))
            given = tables.table(after.join(ends.select("path", "segment", "given"), ["path", "segment"]).filter("start <> given").select("path", "segment", "start"), "given")
            if given.isEmpty():
                break
        chosen = materialize(known.filter("start is not null").drop("given", "segment"), "pieces")

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, a, b, cut, lo, hi, before in part.itertuples(index=False, name=None):
                text = _read(path, lo, hi).decode("utf-8", "replace")
                piece = text[a - before : b - before]
                first = lo + len(text[: a - before].encode())
                out.append((path, a, b, first, first + len(piece.encode()), cut, piece))
            yield pd.DataFrame(out, columns=["path", "start", "end", "first_byte", "past_byte", "cut", "piece"])

    return chosen.select("path", "start", "end", "cut", "lo", "hi", "before").mapInPandas(emit, "path string, start bigint, end bigint, first_byte bigint, past_byte bigint, cut string, piece string")


_PIECES = "path string, segment bigint, given bigint, start bigint, end bigint, cut string, lo bigint, hi bigint, before bigint"


def _segment_pieces(key: tuple, part: pd.DataFrame, limit: int, overlap: int, segment: int) -> pd.DataFrame:
    """The pieces that start inside a segment, with the bytes to read for each, and a row without start that says where the next starts."""
    part = part.sort_values("no")
    own = part[part["no"] // segment == key[1]]
    total, size, given = int(part["total"].iloc[0]), int(part["size"].iloc[0]), int(part["start"].iloc[0])
    stop = int(own["before"].iloc[-1] + own["chars"].iloc[-1])
    at, kinds = stitched([(np.asarray(a, dtype=np.int64), np.asarray(k, dtype=np.int8)) for a, k in zip(part["at"], part["kind"])], part["before"])
    chosen, following = chain_until(at, kinds, total, limit, overlap, given, stop)
    before, ends = part["before"].to_numpy(), (part["before"] + part["chars"]).to_numpy()
    first = np.searchsorted(ends, [c[0] for c in chosen], side="right")
    last = np.searchsorted(ends, [c[1] for c in chosen], side="left")
    byte, past = part["byte"].to_numpy(), part["past"].to_numpy()
    rows = [(key[0], key[1], given, a, b, KIND_NAMES[k] if b < total else "end", byte[i], past[j] if past[j] >= 0 else size, before[i]) for (a, b, k), i, j in zip(chosen, first, last)]
    return pd.DataFrame([*rows, (key[0], key[1], given, None, following, None, None, None, None)], columns=["path", "segment", "given", "start", "end", "cut", "lo", "hi", "before"]).astype({c: "Int64" for c in ("start", "end", "lo", "hi", "before")})
