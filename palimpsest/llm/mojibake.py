"""Text that was decoded with the wrong character encoding: found, and restored where enough is left.

1. Every adjacent pair of characters of the corpus is counted, in partial sums per task. What a pair
   adds to the mutual information of neighbours, p(x, y) * pmi(x, y), says how much it belongs to the
   language: pairs of ordinary words add much, an accented capital inside a word next to nothing.
2. A pair's score is log2(``USUAL`` / contribution), less ``STRANGE``: above zero it is improbable.
   Maximum-scoring segments of improbable pairs around a strange character (a rare letter, a sign, a
   capital after a small letter, a substitute) are the runs.
3. Only inside runs the inverse mappings are tested: UTF-8 shown in a single-byte encoding, once or
   several times over, and one single-byte encoding shown in another. A mapping is taken if the run
   becomes more probable by its margin; what succeeds clearly in a text may succeed by less elsewhere
   in it. Substitutes (U+FFFD, SUB, or a question mark inside a word) are lost characters: they count
   as found, and are restored only where one letter fits far better than all others.

The alphabet is fixed (``alphabet``), so the collected table of pairs is bounded by its square and does
not grow with the corpus. Null and empty texts hold nothing to find. Repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import codes, slices
from .encodings import RIGHT, WRONG, WRONG_BYTES, _ordinary, decoded, high, plausible, utf8_pattern

#: Contribution, in bits, from which on a pair counts as usual; bounds of a pair's score.
USUAL, LEAST, MOST = 2.0**-12, -4.0, 12.0
#: Score above which a pair with a strange character opens a run: garbling may be common enough to look usual.
STRANGE = -3.0
#: Gains in bits from which on an inverse mapping is believed: for UTF-8, for single bytes, and for either once proven in the text.
MARGIN = {"utf8": 1.0, "byte": 6.0}
PROVEN_MARGIN = {"utf8": -8.0, "byte": 0.5}
#: Lead in bits that the best letter for a lost character needs.
LOST_LEAD = 3.0
SUBSTITUTES = "�\x1a"
#: Share of the corpus below which a letter is rare.
RARE = 5e-5
#: Unchanged characters that may lie between two improbable pairs of one run.
GAP = 2


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Class of every code point below 0x10000: one each for those that European text or its garbling holds, one for the rest."""
    known = set(range(0x250)) | set(range(0x370, 0x460)) | set(range(0x2000, 0x2070)) | {0xFFFD, 0xFB01, 0xFB02}
    for name in WRONG:
        known |= {ord(c) for c in high(name)}
    lut = np.zeros(0x10000, dtype=np.int64)
    lut[:] = len(known)
    lut[sorted(known)] = np.arange(len(known))
    return lut


def classes() -> int:
    return int(alphabet().max()) + 1


def _classified(flat: np.ndarray) -> np.ndarray:
    return alphabet()[np.minimum(flat, 0xFFFF)]


def pair_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(pair, n): how often each pair of classes is adjacent in the texts; pre-summed in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = classes()
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for lo, hi in slices(texts):
                c = _classified(codes(texts[lo:hi])[0])
                total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], names=["pair", "n"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def rare_letters(pairs: np.ndarray, n: np.ndarray) -> set[str]:
    """Letters whose small form makes up less than ``RARE`` of the corpus."""
    seen = np.bincount(pairs // classes(), weights=n, minlength=classes())
    low = RARE * max(1.0, float(n.sum()))
    return {chr(p) for p in range(0x80, 0x250) if chr(p).isalpha() and seen[alphabet()[min(ord(chr(p).lower()[0]), 0xFFFF)]] < low}


def improbability(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Score of every pair of classes, as a (classes, classes) array."""
    k = classes()
    joint = np.full(k * k, 0.25)
    joint[pairs] += n
    total = max(1.0, float(n.sum()))
    joint = (joint / total).reshape(k, k)
    observed = np.zeros(k * k)
    observed[pairs] = n
    observed = observed.reshape(k, k) / total
    left, right = observed.sum(axis=1) + 0.25 / total, observed.sum(axis=0) + 0.25 / total
    pmi = np.log2(joint / left[:, None] / right[None, :])
    contribution = joint * np.maximum(pmi, 0.05)
    score = np.clip(np.log2(USUAL / contribution), LEAST, MOST)
    # capitals are rare: a pair that begins with one is as usual as its small form, after a capital or before a small letter
    known = {int(c): p for p, c in reversed(list(enumerate(alphabet()[:0x250])))}
    small = np.arange(k)
    for c, p in known.items():
        low = chr(p).lower()
        if chr(p).isupper() and len(low) == 1 and ord(low) < 0x250:
            small[c] = alphabet()[ord(low)]
    folded = score[small][:, small]
    upper = small != np.arange(k)
    score[upper] = np.minimum(score[upper], folded[upper])
    return score.astype(np.float32)


class Repairer:
    def __init__(self, score: np.ndarray, rare: set[str]) -> None:
        self.score = score
        self.rare = rare
        self.lut = alphabet()
        chars = [chr(p) for p in range(0x10000)]
        self.upper, self.lower = (np.array([p >= least and f(c) for p, c in enumerate(chars)]) for least, f in ((0x80, str.isupper), (0x41, str.islower)))
        self.strange = np.array([p == 0x1A or p >= 0x80 and (c in rare or not c.isalpha() or p >= 0x250) for p, c in enumerate(chars)])
        self.memo: dict[str, list[tuple[float, str, str]]] = {}
        self.singles = {(w, r): self._table(w, r) for w in WRONG_BYTES for r in RIGHT if w != r}

    @staticmethod
    def _table(wrong: str, right: str) -> dict[str, str]:
        out = {}
        back = {b: c for c, b in high(right).items() if not (len(c) == 1 and 0x80 <= ord(c) < 0xA0)}
        for c, b in high(wrong).items():
            if b in back and not 0x80 <= ord(c) <= 0xA0 and ord(c) != 0xAD:
                out[c] = back[b]
        return out

    def cost(self, text: str) -> float:
        c = self.lut[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)]
        return float(self.score[c[:-1], c[1:]].sum())

    def runs(self, texts: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Per text, the ranges that maximum-scoring segments of improbable pairs cover."""
        flat, starts = codes(texts)
        c = _classified(flat)
        s = self.score[c[:-1], c[1:]]
        small = np.minimum(flat, 0xFFFF)
        odd = self.strange[small]
        odd[1:] |= self.upper[small[1:]] & self.lower[small[:-1]]
        odd |= flat > 0xFFFF
        asked = np.flatnonzero(flat == 0x3F)
        if len(asked):  # question marks count only with letters at both sides
            letter = (flat >= 0x61) & (flat <= 0x7A) | (flat >= 0x41) & (flat <= 0x5A) | (flat >= 0xC0)
            before, after = np.maximum(asked - 1, 0), np.minimum(asked + 1, len(flat) - 1)
            for _ in range(3):  # over repeated marks
                before = np.where(flat[before] == 0x3F, np.maximum(before - 1, 0), before)
                after = np.where(flat[after] == 0x3F, np.minimum(after + 1, len(flat) - 1), after)
            odd[asked[letter[before] & letter[after]]] = True
        hot = np.flatnonzero((s > STRANGE) & (odd[:-1] | odd[1:]))
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(hot):
            return out
        cuts = np.flatnonzero(np.diff(hot) > GAP + 1) + 1
        for own in np.split(hot, cuts):
            for lo, hi in self._segments(s, int(own[0]), int(own[-1])):
                self._cover(out, flat, odd, starts, lo, hi)
        return out

    @staticmethod
    def _cover(out: dict[int, list[tuple[int, int]]], flat: np.ndarray, odd: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> None:
        """Adds the range of a segment, widened over the odd characters beside it, to its text's ranges."""
        while lo > 0 and (flat[lo - 1] >= 0x80 or odd[lo - 1]):
            lo -= 1
        while hi < len(flat) and (flat[hi] >= 0x80 or odd[hi]):
            hi += 1
        t = int(np.searchsorted(starts, lo, side="right")) - 1
        first, last = int(starts[t]), int(starts[t + 1]) - 1
        span = (max(lo, first) - first, min(hi, last) - first)
        mine = out.setdefault(t, [])
        if mine and span[0] < mine[-1][1]:
            mine[-1] = (mine[-1][0], max(mine[-1][1], span[1]))
        elif span[0] < span[1]:
            mine.append(span)

    @staticmethod
    def _segments(s: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
        """The characters of all maximal scoring segments of pairs within [first, last]: the best one, and those of what is left at its sides."""
        out, todo = [], [(first, last)]
        while todo:
            first, last = todo.pop()
            best = total = 0.0
            lo = begin = first
            end = first - 1
            for k in range(first, last + 1):
                if total <= 0:
                    total, lo = 0.0, k
                total += float(s[k]) - STRANGE
                if total > best:
                    best, begin, end = total, lo, k
            if end >= begin and best > 0:
                out.append((begin, end + 2))
                todo += [(a, b) for a, b in ((first, begin - 1), (end + 1, last)) if a <= b]
        return sorted(out)

    def odd(self, left: str, run: str) -> bool:
        """Whether a run holds a rare letter, a sign inside a word, or a capital after a small letter."""
        text = left + run
        for i, c in enumerate(text):
            before = text[i - 1] if i else " "
            if c >= "\x80" and i >= len(left) and (c in self.rare or (c.isupper() and before.islower()) or (not c.isalpha() and before.isalpha())):
                return True
        return False

    def candidates(self, left: str, run: str) -> list[tuple[str, str, str]]:
        """Restored forms of a run: kind, name of the mapping, text."""
        out = []
        for name in WRONG:
            now = run
            for depth in range(1, 4):
                new = utf8_pattern(name).sub(lambda m: m[0] if _ordinary(m[0]) else decoded(m[0], name) or m[0], now)
                if new == now:
                    break
                now = new
                out.append(("utf8", f"utf-8 as {name}" + (f" x{depth}" if depth > 1 else ""), now))
        for (wrong, right), table in self.singles.items() if self.odd(left, run) else ():
            new = "".join(c if c < "\x80" else table.get(c, "\0") for c in run)
            if new != run and "\0" not in new and all(c < "\x80" or (plausible(c) and (c.isalpha() or c in "“”‘’—–…«»")) for c in new):
                out.append(("byte", f"{right} as {wrong}", new))
        return out

    def lost(self, left: str, run: str, right: str) -> tuple[str, int, int]:
        """A run with its substitutes filled where one letter leads: text, substitutes, how many were filled."""
        marks = [i for i, c in enumerate(run) if c in SUBSTITUTES or c == "?" and self._in_word(left + run + right, i + len(left))]
        filled = 0
        now = run
        for i in marks:
            around = left + now + right
            k = i + len(left)
            if around[k - 1 : k] in ("", "?", *SUBSTITUTES) or around[k + 1 : k + 2] in ("", "?", *SUBSTITUTES):
                continue
            ranked = sorted((self.cost(around[k - 1] + c + around[k + 1]), c) for c in "áàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇñüèìòùäöïë")
            if ranked[0][0] < 0 and ranked[1][0] - ranked[0][0] >= LOST_LEAD:
                now = now[:i] + ranked[0][1] + now[i + 1 :]
                filled += 1
        return now, len(marks), filled

    @staticmethod
    def _in_word(text: str, i: int) -> bool:
        lo, hi = i, i
        while lo > 0 and text[lo] == "?":
            lo -= 1
        while hi < len(text) - 1 and text[hi] == "?":
            hi += 1
        return text[lo].isalpha() and text[hi].isalpha()

    def options(self, left: str, run: str, right: str) -> list[tuple[float, str, str, str]]:
        key = f"{left}\0{run}\0{right}"
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            before = self.cost(left + run + right)
            self.memo[key] = sorted(((before - self.cost(left + new + right), kind, name, new) for kind, name, new in self.candidates(left, run)), key=lambda x: (-x[0], x[2]))
        return self.memo[key]

    def repair(self, text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int, list[str]]:
        """The text with its runs restored, how many runs were, how many characters are lost, and the mappings."""
        seen = []
        proven: dict[str, int] = {}
        for lo, hi in spans:
            left, run, right = text[max(0, lo - 1) : lo], text[lo:hi], text[hi : hi + 1]
            ranked = self.options(left, run, right)
            seen.append((lo, hi, left, run, right, ranked))
            for gain, kind, name, _ in ranked[:1]:
                if gain >= MARGIN[kind]:
                    proven[name] = proven.get(name, 0) + 1
        out, done, restored, gone, names = [], 0, 0, 0, set()
        for lo, hi, left, run, right, ranked in seen:
            best = next((x for x in ranked if x[0] >= (PROVEN_MARGIN if x[2] in proven else MARGIN)[x[1]]), None)
            now = run
            if best:
                now = best[3]
                restored += 1
                names.add(best[2])
            now, marks, _ = self.lost(left, now, right)
            gone += marks
            if now != run:
                out += [text[done:lo], now]
                done = hi
        out.append(text[done:])
        return "".join(out), restored, gone, sorted(names)


def repaired(df: DataFrame, id_col: str, text_col: str, *, changed_only: bool = False) -> DataFrame:
    """(id, text, restored, lost, mappings): every row, or only those with garbled sequences."""
    spark = df.sparkSession
    table = pair_counts(df, text_col).toPandas()  # bounded by the square of the fixed alphabet
    pairs, n = table["pair"].to_numpy(dtype=np.int64), table["n"].to_numpy(dtype=np.int64)
    model = spark.sparkContext.broadcast((improbability(pairs, n), rare_letters(pairs, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Repairer(*model.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices([t or "" for t in texts]):
                part = [t or "" for t in texts[lo:hi]]
                spans = tool.runs(part)
                fixed = {t: tool.repair(part[t], own) for t, own in spans.items()}
                fixed = {t: r for t, r in fixed.items() if r[1] or r[2]}
                keep = sorted(fixed) if changed_only else range(hi - lo)
                plain = ("", 0, 0, [])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([lo + t for t in keep], pa.int64())),
                        pa.array([fixed[t][0] if t in fixed else texts[lo + t] for t in keep], pa.string()),
                        *(pa.array([fixed.get(t, plain)[j] for t in keep], pa.int32()) for j in (1, 2)),
                        pa.array([fixed.get(t, plain)[3] for t in keep], pa.list_(pa.string())),
                    ],
                    names=["id", "text", "restored", "lost", "mappings"],
                )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return (rows.filter("text is not null") if changed_only else rows).mapInArrow(run, "id bigint, text string, restored int, lost int, mappings array<string>")
