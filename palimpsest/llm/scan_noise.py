"""Noise of scanned pages: broken words, misread characters, running headers, printed page numbers.

Counts over the whole corpus come first: a frequency lexicon (words above ``SHARE`` of all words, so at
most 1 / ``SHARE`` entries), and for every book the lines at page edges that may be running headers. Workers build a
symmetric-delete index over the lexicon's confusion skeletons: words that scanners confuse share a
skeleton or one of its single deletions. A word outside the lexicon, or one that is far rarer than a
confusable word, is compared to its candidates by an edit distance in which confusion pairs are cheap;
among close candidates the one that the corpus has seen beside the same neighbours is taken. Texts with such a choice
name the pairs of words they ask for; these are counted over the corpus, and the texts are finished with the answers.

A line at a page's edge that is set like a header is one if a page number is printed beside it, or if it comes back at the
edges of at least ``RECURS`` pages of its book, misread letters aside. A title that stands over its chapter once stays.

The repair of a text: garbled UTF-8 and look-alike characters are first brought to their form, so that
they are not taken for misreadings; lines that are page numbers, page markers or running headers go;
words broken at line ends are joined, true compounds kept; misread words are replaced; lines join to
paragraphs at blank lines. Null stays null and counts nothing; empty stays empty. Repeated rows are
treated alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, broadcast_if_small, materialize
from .encodings import WRONG, _ordinary, decoded, may_be_garbled, utf8_pattern
from .normal_form import _unstable, normalize

#: Share of all words from which on a word is in the lexicon; it bounds the lexicon at 1 / SHARE words.
SHARE = 1e-5
#: Distinct word pairs that a counting worker holds before it hands them on.
HELD_PAIRS = 2_000_000
#: Costs of the weighted edit distance, and what a repair may cost alone or with a seen neighbour.
CONFUSION, ACCENT, EDIT = 0.4, 0.5, 1.5
ALONE, WITH_CONTEXT = 0.5, 1.0
#: How many times more frequent than a lexicon word its correction must be.
RATIO = 15
#: Pages of a book at whose edges a line without a page number must come back to be a running header.
RECURS = 2
#: Pairs of words asked for that are broadcast, at most, so that only they are counted; beyond it all are counted and joined.
ASKED_BROADCAST = 1_000_000
#: Books whose headers are broadcast, at most; more are joined by a shuffle.
BOOKS_BROADCAST = 200_000

# What scanners take for what, single characters first, then groups.
CONFUSED = "o0 a@ o@ ec ij i! i1 i| l1 l| l! ij lj tf s5 g9 b6 ó6 ã5 vy çg çc hb".split()
GROUPS = [("m", "rn"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("h", "li"), ("w", "vv")]
BASE = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
SKELETON = str.maketrans("o@0cçg9ejl1|!fy56", "aaaccccciiiiitvsb")
LETTERS = set("abcdefghijklmnopqrstuvwxyzáàâãäéèêëíìîïóòôõöúùûüçñ")

_DIGITS = str.maketrans("oil|s", "01115")
_PAIRS = {frozenset(p) for p in CONFUSED}
_TOKEN = re.compile(r"[\w@|!]+(?:-[\w@|!]+)*")
_MARKS = "-¬–=‐"
_JOIN = re.compile(r"[" + _MARKS + r"][ \t]*\r?\n[ \t]*(?=[a-zà-ÿ])")
_BREAK = re.compile(r"[" + _MARKS + r"]([ \t]*(?:\r?\n[ \t\r\n]*)?)(?=[^\W\d_])")
_REST = re.compile(r"[^\W\d_]+")
#: Characters that can belong neither to a garbled sequence nor to a look-alike, in texts that hold no others.
_SAFE = frozenset([*map(chr, range(0x80)), *"áàâãéêíóôõúçÁÀÂÉÊÍÓÔÕÚÇÃ—–“”‘’…¬"])
_HARD = re.compile(r"[\d@|!]")
_D = r"[0-9][0-9OolI|S]{0,3}|[OlI|S][0-9][0-9OolI|S]{0,2}"
_NUMBER_LINE = re.compile(rf"(?i)^([-–—·\[(|*~]{{0,3}}\s*)((?:p|p[áa]g|p[áa]gina|page)\b\.?\s*)?(?:{_D})(\s*(?:/|of|de)\s*(?:{_D}))?(\s*[-–—·\])|*~]{{0,3}}\.?)$")
_CHAPTER = re.compile(rf"(?i)^cap[ií]tu[l1|][o0]\s+(?:{_D}|[ivxl]{{1,6}})(\s+(?:{_D}))?$")
_NUMBERED = re.compile(rf"^(?:(?:{_D})\s+(\S.*)|(.*\S)\s+(?:{_D}))$")
_CAPS = "[A-ZÀ-ÖØ-Ý0]"
_CAPS_RUN = rf"(?:{_CAPS}[.]\s+)?{_CAPS}[A-ZÀ-ÖØ-Ý0,.]*(?:\s+{_CAPS}[A-ZÀ-ÖØ-Ý0,]*)*"
_INLINE = [
    re.compile(rf"(?<=[a-zà-ÿ,;])[ \t]+(?:{_D})\s+({_CAPS_RUN})(?=\s+[a-zà-ÿ])"),
    re.compile(rf"(?<=[a-zà-ÿ,;])[ \t]+({_CAPS_RUN})\s+(?:{_D})(?=\s+[a-zà-ÿ])"),
]
_INLINE_NUMBER = re.compile(rf"--\s*(?:{_D})\s+(?:of|de)\s+(?:{_D})\s*--|(?<=[a-zà-ÿ,;])[ \t]+(?:[—–-]\s?(?:{_D})\s?[—–-]|·\s?(?:{_D})\s?·|\[(?:{_D})\]|P[áa]g(?:ina|\.)\s?(?:{_D}))(?=\s+[a-zà-ÿ])")
# What any match of the patterns above holds, so that the hints only spare work: every _D has a digit in its first two characters.
_INLINE_HINT = re.compile(rf"\d[\dOolI|S]{{0,3}}\s+{_CAPS}|{_CAPS}[.,]*\s+[OlI|S]?\d")
_NUMBER_HINT = re.compile(r"[—–·\[-]\s*[OlI|S]?\d|P[áa]g")
_LINE_HINT = re.compile(r"[\dA-ZÀ-ÖØ-Ý][A-ZÀ-ÖØ-Ý]|\d")
_DIGIT = re.compile(r"\d")
_LOUD = re.compile(r"[A-ZÀ-ÖØ-Ý]{2}")
_LINE = re.compile(r"\r\n|\n|\r")
_BLANK_LINES = re.compile(r"\n[ \t]*\n+")


def undone(text: str) -> str:
    """Characters of problems 1 and 5 brought to their form, where there are any."""
    if _SAFE.issuperset(text):
        return text
    if may_be_garbled(text):
        for name in WRONG:
            text = utf8_pattern(name).sub(lambda m: m[0] if _ordinary(m[0]) else decoded(m[0], name) or m[0], text)
    return normalize(text)[0] if _unstable().search(text) else text


def skeletons(word: str) -> set[str]:
    """The plain and the merged skeleton of a lower-case word."""
    merged = word
    for one, group in GROUPS:
        merged = merged.replace(group, one)
    variants = {word, merged}
    for v in list(variants):
        if "5" in v or "6" in v:
            variants.add(v.replace("5", "ã").replace("6", "ó"))
    return {v.translate(BASE).translate(SKELETON) for v in variants}


def deletions(s: str) -> set[str]:
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


@lru_cache(maxsize=4096)
def _substitution(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if frozenset((a, b)) in _PAIRS:
        return CONFUSION
    x, y = a.translate(BASE), b.translate(BASE)
    if x == y:
        return ACCENT
    return CONFUSION if frozenset((x, y)) in _PAIRS and not (a in "çg" and b in "çg") and (a in "0@!1|569" or b in "0@!1|569") else EDIT


def distance(seen: str, meant: str, most: float = WITH_CONTEXT) -> float:
    """Weighted edit distance; groups of letters taken for one count once. Beyond ``most`` it is only a bound."""
    rows: list[list[float]] = [[j * EDIT for j in range(len(meant) + 1)]]
    for i in range(1, len(seen) + 1):
        row = [i * EDIT]
        for j in range(1, len(meant) + 1):
            best = min(rows[i - 1][j] + EDIT, row[j - 1] + EDIT, rows[i - 1][j - 1] + _substitution(seen[i - 1], meant[j - 1]))
            for one, group in GROUPS:
                if i >= 2 and meant[j - 1] == one and seen[i - 2 : i] == group:
                    best = min(best, rows[i - 2][j - 1] + CONFUSION)
            row.append(best)
        if min(row) > most and (not rows[-1] or min(rows[-1]) > most):
            return EDIT * max(len(seen), len(meant))
        rows.append(row)
    return rows[-1][-1]


def _pair(a: np.ndarray | int, b: np.ndarray | int):
    """The hash of two words beside each other, from their own."""
    if isinstance(a, int):
        mask = (1 << 64) - 1
        return (((a * 0x9E3779B97F4A7C15) & mask) ^ b) * 0xBF58476D1CE4E5B9 & mask
    return ((a * np.uint64(0x9E3779B97F4A7C15)) ^ b) * np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=500_000)
def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _title(line: str) -> str:
    """'caps', 'title' or '': how a line without its number is set."""
    letters = [c for c in line if c.isalpha()]
    if len(letters) < 4 or line[-1] in "!?;:,.…”" or line[0] in "—–-“":
        return ""
    if sum(c.isupper() for c in letters) >= 0.8 * len(letters):
        return "caps"
    words = line.split()
    long = [w for w in words if len(w) >= 4]
    small = {"sobre", "entre", "para", "pelo", "pela", "contra"}
    if long and len(words) <= 9 and words[0][0].isupper() and all(w[0].isupper() or w in small for w in long) and sum(w[0].isupper() for w in words) >= max(1, len(long) - 1):
        return "title"
    return ""


class Page:
    """Lines of one page; ``gone`` are those that are taken for page numbers or headers so far."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.full = [i for i, x in enumerate(lines) if x and not x.isspace()]
        self.gone: set[int] = set()
        self.numbers = 0
        self.headers: list[tuple[int, str, bool]] = []

    def scan(self, recurring: frozenset[int] | set[int] | None) -> Page:
        """Finds page numbers and headers; without a set of recurring lines, all that could be a header is one."""
        for at, i in enumerate(self.full):
            line = self.lines[i]
            if len(line) > 160 or not (at <= 1 or _LINE_HINT.search(line)):
                continue
            line = " ".join(line.split())
            if len(line) > 80:
                continue
            if _DIGIT.search(line) and _NUMBER_LINE.match(line):
                if self._is_number(at, _NUMBER_LINE.match(line)):
                    self.gone.add(i)
                    self.numbers += 1
                continue
            printed = self._like_header(at, line)
            if printed is not None and (printed or recurring is None or header_key(line) in recurring):
                self.gone.add(i)
                self.headers.append((i, line, printed))
        return self

    def _near(self, at: int) -> tuple[str, str]:
        before = self.lines[self.full[at - 1]].rstrip() if at else ""
        return before, self.lines[self.full[at + 1]].lstrip() if at + 1 < len(self.full) else ""

    def _is_number(self, at: int, m: re.Match) -> bool:
        """Whether a line that is a number is a printed one, not the end of a sentence."""
        before = self._near(at)[0]
        bare = not (m[1] or m[2] or m[3]) and m[4] in ("", ".")
        going_on = before and before[-1] not in ".!?”\"»…:—|" and self.full[at - 1] not in self.gone
        return not (bare and m[4] == "." and going_on)

    def _like_header(self, at: int, line: str) -> bool | None:
        """None if a line is not set like a header; else whether a page number stands beside it."""
        i, full = self.full[at], self.full
        first = at == 0 or all(k in self.gone for k in full[:at]) if at < 8 else False
        if _DIGIT.search(line):
            m = _CHAPTER.match(line)
            if m:
                return bool(m[1])
            m = _NUMBERED.match(line)
            if m:
                kind = _title(m[1] or m[2])
                return True if kind == "caps" and not self._loud(at) or kind == "title" and self._alone(at) else None
        if not (_LOUD.search(line) or at <= 1):
            return None
        kind = _title(line)
        if kind == "caps":
            edge = at == len(full) - 1 or first or self._apart(i)
            return False if edge and not self._loud(at) else None
        after = self._near(at)[1]
        if kind == "title" and first and len(line) <= 50 and len(line.split()) > 1 and after and (after[0].isupper() or after[0] in "—–“"):
            return False
        return None

    def _apart(self, i: int) -> bool:
        return bool(i) and self.lines[i - 1].strip() == "" and (i + 1 >= len(self.lines) or self.lines[i + 1].strip() == "")

    def _alone(self, at: int) -> bool:
        return at == 0 or at == len(self.full) - 1 or self.full[at - 1] in self.gone or self._apart(self.full[at])

    def _loud(self, at: int) -> bool:
        """Whether a line of capitals belongs to a sentence in capitals that runs over several lines."""
        i, full = self.full[at], self.full
        before, after = self._near(at)
        first = after.split()[0] if after and full[at + 1] == i + 1 else ""
        last = before.split()[-1] if before and full[at - 1] == i - 1 and full[at - 1] not in self.gone else ""
        return len(first) > 1 and first.isupper() and not _CHAPTER.match(after) or len(last) > 1 and last.isupper() and last[-1] not in ".!?" and last.strip(",").isalpha()

    def left(self) -> list[str]:
        return [x for i, x in enumerate(self.lines) if i not in self.gone] if self.gone else self.lines


def header_candidates(text: str) -> list[int]:
    """Keys of the lines of a text that could be running headers."""
    return [header_key(undone(line)) for p in text.split("\f") for _, line, _ in Page(_LINE.split(p)).scan(None).headers]


def header_key(line: str) -> int:
    """What the lines of one running header share: letters by their confusion classes, and the number of a chapter."""
    m = _CHAPTER.match(line)
    if m:
        words = line.split()
        return _hash("chapter " + words[1].lower().translate(_DIGITS))
    m = _NUMBERED.match(line)
    return _hash("".join(c for c in min(skeletons((m[1] or m[2] if m else line).lower())) if c.isalpha()))


def corpus_counts(df: DataFrame, text_col: str, book_col: str) -> DataFrame:
    """(kind, word, hash, n): words ('w'), and keys of a book's header-like lines at page edges ('h', ``word`` is the book)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def rows(kind: str, word: list[str], own: list[int | None], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array(word, pa.string()), pa.array(own, pa.int64()), pa.array(n, pa.int64())], names=["kind", "word", "hash", "n"])

        for batch in batches:
            heads: Counter = Counter()
            for t, book in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    words.update(_words_of(t))
                    heads.update((book, key) for key in header_candidates(t))
            yield rows("h", [b for b, _ in heads], [_signed(k) for _, k in heads], list(heads.values()))
            if len(words) > 500_000:  # hand on what is counted, to hold no more than that
                yield rows("w", list(words), [None] * len(words), list(words.values()))
                words.clear()
        yield rows("w", list(words), [None] * len(words), list(words.values()))

    return df.select(F.col(text_col).alias("text"), F.col(book_col).alias("book")).mapInArrow(run, "kind string, word string, hash bigint, n bigint").groupBy("kind", "word", "hash").agg(F.sum("n").alias("n"))


def pair_counts(df: DataFrame, text_col: str, asked: np.ndarray | None = None) -> DataFrame:
    """(hash, n): how often two words stand beside each other, of all pairs or of those with the hashes ``asked``, which are sorted."""
    wanted = df.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        hashes = np.zeros(0, dtype=np.uint64)
        pairs, seen = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, at = np.unique(np.concatenate(pairs), return_inverse=True)
            return own, np.bincount(at, weights=np.concatenate(seen), minlength=len(own)).astype(np.int64)

        def rows(own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in batches:
            flat: list[str] = []
            for t in batch.column(0).to_pylist():
                if t:
                    flat += _words_of(t)
                    flat.append("\n")
            if not flat:
                continue
            if len(ids) > 500_000:
                ids, hashes = {}, hashes[:0]
            first, fresh = len(ids), sorted(set(flat).difference(ids))
            ids.update((w, first + k) for k, w in enumerate(fresh))
            hashes = np.concatenate([hashes, np.array([_hash(w) for w in fresh], dtype=np.uint64)])
            h = hashes[np.fromiter(map(ids.__getitem__, flat), dtype=np.int64, count=len(flat))]
            own = _pair(h[:-1], h[1:])
            if wanted.value is not None:
                own = own[np.isin(own, wanted.value)]
            own, n = np.unique(own, return_counts=True)
            pairs.append(own)
            seen.append(n)
            if sum(map(len, pairs)) > HELD_PAIRS:
                own, n = merged()
                if len(own) > HELD_PAIRS // 2:
                    yield rows(own, n)
                    own, n = own[:0], n[:0]
                pairs, seen = [own], [n]
        yield rows(*merged())

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _words_of(text: str) -> list[str]:
    return _TOKEN.findall(_JOIN.sub("", text).lower())


def lexicon_of(counts: DataFrame) -> dict[str, int]:
    """Words above ``SHARE`` of all words, with their counts."""
    words = counts.filter("kind = 'w'")
    least = max(2, int((words.agg(F.sum("n")).first()[0] or 0) * SHARE))
    return {r.word: r.n for r in words.filter(F.col("n") >= least).select("word", "n").toLocalIterator() if all(c in LETTERS for c in r.word.replace("-", ""))}


class Repairer:
    """Repairs by a lexicon. Without ``answers`` it only notes in ``asked`` the word pairs that a choice would need."""

    def __init__(self, lexicon: dict[str, int], answers: dict[int, int] | None = None) -> None:
        self.lexicon, self.answers = lexicon, answers
        self.asked: set[int] = set()
        self.total = sum(lexicon.values()) or 1
        self.index: dict[str, list[str]] = {}
        for w in lexicon:
            if 3 <= len(w) <= 40 and "-" not in w:
                for k in {d for s in skeletons(w) for d in deletions(s)}:
                    self.index.setdefault(k, []).append(w)
        self.memo: dict[str, list[tuple[float, str]]] = {}
        self.fine: set[str] = set()

    def corrections(self, word: str) -> list[tuple[float, str]]:
        """Candidates for a lower-case word by cost, frequent ones first among equals; none for words as they should be."""
        if word in self.memo:
            return self.memo[word]
        known = self.lexicon.get(word, 0)
        out: list[tuple[float, str]] = []
        if 3 <= len(word) <= 40:
            seen = {w for s in skeletons(word) for d in deletions(s) for w in self.index.get(d, ())}
            hard = _HARD.search(word) is not None
            for w in seen:
                if w == word or abs(len(w) - len(word)) > 2:
                    continue
                n = self.lexicon[w]
                if not hard and (len(w) < 4 and n < 1e-3 * self.total or known and n < RATIO * known):
                    continue
                cost = distance(word, w)
                if cost <= (ALONE if known or len(w) < 4 else WITH_CONTEXT):
                    out.append((cost, w))
        out.sort(key=lambda x: (x[0], -self.lexicon[x[1]], x[1]))
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def beside(self, before: str, word: str, after: str) -> int:
        """How often the corpus has the word right after the one before or right before the one after."""
        pairs = _pair(_hash(before), _hash(word)), _pair(_hash(word), _hash(after))
        if self.answers is None:
            self.asked.update(pairs)
            return 0
        return sum(self.answers.get(p, 0) for p in pairs)

    def meant(self, token: str, before: str, after: str) -> str | None:
        """The word that a token was read from, or None if the token stands as it is."""
        low = token.lower()
        if any(a.islower() and b.isupper() for a, b in zip(token, token[1:])):
            return None
        ranked = self.corrections(low)
        if not ranked:
            return None
        near = [w for cost, w in ranked if cost <= ranked[0][0] + 0.15]
        best = near[0] if len(near) == 1 else max(near, key=lambda w: (self.beside(before, w, after), self.lexicon[w]))
        cost = next(c for c, w in ranked if w == best)
        hard = _HARD.search(low) is not None
        if low.translate(BASE) == best.translate(BASE) and (len(low) < 5 or not token.islower()):
            return None  # short words and names may differ by an accent alone; capitals often go without
        if cost > ALONE and not hard and not self.beside(before, best, after):
            return None
        return best.upper() if token.isupper() and len(best) > 1 else best.capitalize() if token[:1].isupper() or (hard and token[:1].isdigit() and token[1:2].isupper()) else best

    def joined(self, a: str, mark: str, gap: str, b: str) -> str | None:
        """The whole word that a mark breaks, or None if the mark belongs there."""
        if not (b[0].islower() or (a.isupper() and b.isupper() and len(a) > 1)):
            return None
        whole, compound = (a + b).lower(), f"{a}-{b}".lower()
        n, kept = self.lexicon.get(whole, 0), self.lexicon.get(compound, 0)
        if mark in "-‐" and kept > n:
            return None
        if "\n" in gap or "\r" in gap:
            return a + b
        if gap:
            return a + b if mark != "–" or n or not (a.lower() in self.lexicon and b.lower() in self.lexicon) else None
        return a + b if n and (mark in "¬=" or not (a.lower() in self.lexicon and b.lower() in self.lexicon)) else None

    def prepared(self, text: str, recurring: frozenset[int] | set[int] | None) -> tuple[str, int, int, int]:
        """The text in its lines without headers and page numbers and with broken words whole: (text, joined, headers, numbers)."""
        text = undone(text)
        pages = [Page(_LINE.split(p)).scan(recurring) for p in text.split("\f")]
        headers, numbers = sum(len(p.headers) for p in pages), sum(p.numbers for p in pages)
        body, joined = self.mended("\n".join("\n".join(p.left()) for p in pages))
        if _INLINE_HINT.search(body):
            for pattern in _INLINE:
                hits = [m for m in pattern.finditer(body) if any(len(w.strip(",.")) >= 4 for w in m[1].split())]
                for m in reversed(hits):
                    body = body[: m.start()] + body[m.end() :]
                headers += len(hits)
        if _NUMBER_HINT.search(body):
            body, k = _INLINE_NUMBER.subn("", body)
            numbers += k
        return body, joined, headers, numbers

    def worded(self, body: str) -> tuple[str, int]:
        """The text with misread words replaced, and how many were."""
        self.asked.clear()
        return self._words(body) if self._suspects(body) else (body, 0)

    def repair(self, text: str, recurring: frozenset[int] | set[int] | None = None) -> tuple[str, int, int, int, int]:
        """The text in paragraphs, and how many words were joined, words replaced, headers and page numbers removed."""
        body, joined, headers, numbers = self.prepared(text, recurring)
        body, replaced = self.worded(body)
        return paragraphs(body), joined, replaced, headers, numbers

    def mended(self, body: str) -> tuple[str, int]:
        """The text with broken words whole, and how many were; a word may be broken more than once."""
        out, done, joined = "", 0, 0
        for m in _BREAK.finditer(body):
            at = m.start()
            k = at
            while k > done and body[k - 1].isalpha():
                k -= 1
            left = body[k:at]
            if k == done and out:  # what was joined before belongs to the word
                j = len(out)
                while j and out[j - 1].isalpha():
                    j -= 1
                left = out[j:] + left
            if not left:
                continue
            right = _REST.match(body, m.end())[0]
            if self.joined(left, m[0][0], m[1], right) is None:
                continue
            out += body[done:at]
            done = m.end()
            joined += 1
        return out + body[done:], joined

    def _suspects(self, body: str) -> bool:
        """Whether any word has a candidate; words without one are not looked at again."""
        new = set(_TOKEN.findall(body)) - self.fine
        if len(self.fine) > 500_000:
            self.fine.clear()
        calm = {t for t in new if not any(self.corrections(p) for p in t.rstrip("!").lower().split("-"))}
        self.fine |= calm
        return len(calm) < len(new)

    def _words(self, body: str) -> tuple[str, int]:
        tokens = list(_TOKEN.finditer(body))
        out, done, replaced = [], 0, 0
        for k, m in enumerate(tokens):
            token = m[0]
            if token in self.fine:
                continue
            core = token.rstrip("!")
            if "-" in core:
                parts = core.split("-")
                news = [self._one(p, "", "") for p in parts]
                new = "-".join(n or p for n, p in zip(news, parts)) if any(news) else None
            else:
                new = self._one(core, tokens[k - 1][0].lower() if k else "\n", tokens[k + 1][0].lower() if k + 1 < len(tokens) else "\n")
            if new is None or new == core:
                continue
            out += [body[done : m.start()], new]
            done = m.start() + len(core)
            replaced += 1
        out.append(body[done:])
        return "".join(out), replaced

    def _one(self, core: str, before: str, after: str) -> str | None:
        low = core.lower()
        letters = [c for c in low if c.isalpha()]
        if len(low) < 3 or len(letters) * 2 <= len(low) or any(c not in LETTERS for c in letters) or "_" in low:
            return None
        if low[0].isdigit() and low.rstrip("abcdefghijklmnopqrstuvwxyz").isdigit() and len(letters) <= 2:
            return None  # 3a, 12th
        return self.meant(core, before, after)


def paragraphs(body: str) -> str:
    """Lines joined to paragraphs at blank lines."""
    own = (" ".join(p.split()) for p in _BLANK_LINES.split(body))
    return "\n\n".join(p for p in own if p)


COUNTS = ("joined", "replaced", "headers", "numbers")


def repaired(df: DataFrame, key_cols: list[str], text_col: str, book_col: str | None = None, *, noisy_only: bool = False) -> DataFrame:
    """Keys, repaired text and counts for every row, or keys and counts of the rows that hold noise.

    A row without a book is a book of its own. A row that is noisy without any choice between words is not asked about in ``noisy_only``.
    """
    spark, n_keys = df.sparkSession, len(key_cols)
    rows = df.select(*key_cols, F.col(text_col).alias("text"), F.coalesce(F.col(book_col).cast("string") if book_col else F.lit(None).cast("string"), F.concat_ws("\x00", *key_cols)).alias("book"))
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in key_cols)
    with Scratch(spark) as tables:
        counts = tables.table(corpus_counts(rows, "text", "book"), "counts")
        lexicon = spark.sparkContext.broadcast(lexicon_of(counts))  # bounded by SHARE
        heads = tables.table(counts.filter(f"kind = 'h' and n >= {RECURS}").groupBy(F.col("word").alias("book")).agg(F.collect_list("hash").alias("heads")), "heads")
        booked = rows.join(broadcast_if_small(heads, heads.count(), BOOKS_BROADCAST), "book", "left").select(*key_cols, "text", "heads")

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = Repairer(lexicon.value)
            for batch in batches:
                out, keep = [], []
                for i, (t, heads) in enumerate(zip(*(batch.column(n_keys + k).to_pylist() for k in (0, 1)))):
                    if t is None:
                        row = (None, 0, 0, 0, 0, None)
                    else:
                        body, joined, headers, numbers = tool.prepared(t, {h & _FULL for h in heads or ()})
                        noisy = joined + headers + numbers > 0
                        done, replaced = (body, 0) if noisy_only and noisy else tool.worded(body)
                        asked = [_signed(p) for p in sorted(tool.asked)] if tool.asked and not (noisy_only and (noisy or replaced)) else None
                        row = (body if asked else None if noisy_only else paragraphs(done), joined, replaced, headers, numbers, asked)
                    if not noisy_only or any(row[1:5]) or row[5]:
                        keep.append(i)
                        out.append(row)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(n_keys)), pa.array([r[0] for r in out], pa.string()), *(pa.array([r[j] for r in out], pa.int32()) for j in range(1, 5)), pa.array([r[5] for r in out], pa.list_(pa.int64()))], names=[*key_cols, "text", *COUNTS, "asked"])

        looked = tables.table(booked.mapInArrow(first, f"{keys}, text string, " + ", ".join(f"{c} int" for c in COUNTS) + ", asked array<bigint>").withColumn("row", F.monotonically_increasing_id()), "looked")
        pending = looked.filter("asked is not null")
        if pending.isEmpty():
            return materialize(looked.select(*key_cols, "text", *COUNTS), "repaired")
        # the pairs that texts ask for are counted, and go back to each text; a text asks for its own words' pairs only
        asked = tables.table(pending.select(F.explode("asked").alias("hash")).distinct(), "asked")
        n_asked = asked.count()
        known = pair_counts(rows, "text", np.sort(asked.toArrow()["hash"].to_numpy().view(np.uint64)) if n_asked <= ASKED_BROADCAST else None)
        hits = pending.select("row", F.explode("asked").alias("hash")).join(known.join(broadcast_if_small(asked, n_asked), "hash", "left_semi"), "hash")
        answers = hits.groupBy("row").agg(F.collect_list("hash").alias("pairs"), F.collect_list("n").alias("times"))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = Repairer(lexicon.value, {})
            for batch in batches:
                col = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names) if k >= n_keys}
                out = []
                for body, joined, headers, numbers, pairs, times in zip(*(col[c] for c in ("text", "joined", "headers", "numbers", "pairs", "times"))):
                    tool.answers = {p & _FULL: n for p, n in zip(pairs or (), times or ())}
                    text, replaced = tool.worded(body)
                    out.append((None if noisy_only else paragraphs(text), joined, replaced, headers, numbers))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keys)), pa.array([r[0] for r in out], pa.string()), *(pa.array([r[j] for r in out], pa.int32()) for j in range(1, 5))], names=[*key_cols, "text", *COUNTS])

        finished = pending.join(answers, "row", "left").select(*key_cols, "text", *COUNTS, "pairs", "times").mapInArrow(second, f"{keys}, text string, " + ", ".join(f"{c} int" for c in COUNTS))
        if noisy_only:
            finished = finished.filter("joined + replaced + headers + numbers > 0")
        return materialize(looked.filter("asked is null").select(*key_cols, "text", *COUNTS).unionByName(finished), "repaired")


_FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
