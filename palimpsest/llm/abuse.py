"""Abusive, hateful or sexual passages: a recurrent network over all overlapping windows of every text.

Words, written plainly again (spaced-out letters joined, digits and signs read as letters, look-alikes and
accents folded, drawn-out letters shortened), enter as the sum of a word vector and their character
trigrams' mean. A gated recurrent network reads each window of ``WINDOW`` words in both directions; attention pools
its states to one score. Windows start every ``STRIDE`` words and a last one ends with the text, so
every word is seen with context on either side. A document scores as its highest window.

The network is trained here, with numpy, on labels alone: on a bounded sample of labelled documents (``MAX_POSITIVE``
and ``MAX_NEGATIVE``, by a hash of the id, of at most ``MAX_CHARS`` characters each). No word or phrase is given to it.
Labels belong to whole documents: training picks the window that carries the label, first by the words' log-odds,
then by the network itself, leaves out labelled texts that no window speaks for, and uses the highest windows of
clean documents as its hard negatives. Vectors are those of the words and trigrams of the sample, one row each;
all others are zero.

The threshold is one rule at every size. Each labelled document is scored by a network trained without its part of
``FOLDS``; where F1 of these scores is highest lies the sample's own cut. The sample may hold another share of abuse than the
corpus: the share of all documents above that cut is counted, clean labels are weighted so that the sample has
that share, and the threshold lies where the weighted F1 is highest. A training makes the same number of steps at every size;
the ``FOLDS`` + 1 networks are trained in as many tasks.

Null and empty texts have no window and score 0. Documents with conflicting or only null labels are not
trained on. Without any positive or negative label no model can be fitted: every score is 0 then.
Repeated rows score alike. Training is deterministic.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize
from .normal_form import FOLD

WINDOW, STRIDE = 24, 12
#: Labelled documents of either kind that are trained on, at most, and the characters that each may have.
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 3000, 6000, 20_000
#: Log-odds that a window must gather to carry its document's label before the network can tell.
SUPPORT = 6.0
#: Gradient steps between choices of windows, windows of a step, learning rate, chance that a word's own vector is left out.
STEPS, BATCH, RATE, DROP = (120, 80, 80), 256, 0.015, 0.15
#: Windows of a clean document that are trained on for being its highest.
HARD = 2
#: Parts of the labelled documents that are scored in turn by a network trained on the others, for the threshold.
FOLDS = 3
#: Documents of the sample that a word or a trigram must occur in to have a vector.
MIN_DOCS = 2
#: Sizes of the vectors and of the states.
DIM, HIDDEN, ATTENTION = 16, 12, 8
SEED = 7

_TOKEN = re.compile(r"[\w*]+|[“”\"«»]")
_SPACED = re.compile(r"(?<![\w*])[\w*](?:[ .\-_·][\w*]){3,}(?![\w*])")
_RUN = re.compile(r"(.)\1{2,}")
# Digits and signs that stand for letters.
_READ = str.maketrans("0134578@$", "oieastbas")


def plain(token: str) -> str:
    """A token as it would ordinarily be written, lower-case and without accents."""
    t = token.lower()
    if not t.isascii():
        t = "".join(FOLD.get(c, c) for c in unicodedata.normalize("NFKC", t)).lower()
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    if any(c.isdigit() for c in t):
        t = "#" if t.isdigit() else t.translate(_READ)
    return _RUN.sub(r"\1", t)


#: What every run of spaced-out letters holds; only texts with it are looked through for such runs.
_SPACED_HINT = re.compile(r"[ .\-_·][\w*][ .\-_·][\w*][ .\-_·]")


def _join(m: re.Match) -> str:
    return m[0][::2]


def tokenize(text: str) -> list[str]:
    low = text.lower()
    if _SPACED_HINT.search(low):
        low = _SPACED.sub(_join, low)
    return _TOKEN.findall(low)


def trigrams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(max(1, len(w) - 2))]


class Words:
    """Numbers of the plain words met so far; every raw token is read once."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.plain: list[str] = []
        self.seen: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        for token in sorted(set(tokens).difference(self.ids)):
            word = plain(token) or token
            if word not in self.seen:
                self.seen[word] = len(self.plain)
                self.plain.append(word)
            self.ids[token] = self.seen[word]
        return np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int32, count=len(tokens))


class Vocabulary:
    """Rows of the vectors of words and trigrams; row 0 stands for all that have none and stays zero."""

    def __init__(self, words: list[str], grams: list[str]) -> None:
        self.words = {w: i for i, w in enumerate(words, 1)}
        self.grams = {g: i for i, g in enumerate(grams, 1)}

    def rows(self, plain_words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        word, gram = self.words, self.grams
        return np.fromiter((word.get(w, 0) for w in plain_words), dtype=np.int64, count=len(plain_words)), [[gram.get(g, 0) for g in trigrams(w)] for w in plain_words]


def windows(n: int) -> list[int]:
    """Where the windows of a text of ``n`` words start."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _spread(grams: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram rows of all words in a row, where each word's begin, and how many it has."""
    n = np.array([len(g) for g in grams], dtype=np.int64)
    flat = np.array([i for g in grams for i in g], dtype=np.int64)
    return flat, np.cumsum(n) - n, n


def _sums(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Values summed by row."""
    out = np.zeros((size, values.shape[1]), dtype=np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        at = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out[rows[order][at]] = np.add.reduceat(values[order], at, axis=0)
    return out


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the bounded activation, a ninth of the cost of tanh."""
    bound = np.abs(x)
    bound += np.float32(1)
    x /= bound
    return x


def slope(s: np.ndarray) -> np.ndarray:
    """The derivative of ``squash`` by its value."""
    d = 1 - np.abs(s)
    return d * d


class Network:
    """Weights and passes. Both directions run at once and windows lie last, so that slices of gates stay whole: (direction, gate, window)."""

    def __init__(self, seed: int = SEED, words: int = 0, grams: int = 0) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        h = HIDDEN
        self.p = {"word": np.zeros((words + 1, DIM), np.float32), "gram": np.zeros((grams + 1, DIM), np.float32), "A": f(ATTENTION, 2 * h, k=0.2), "v": f(ATTENTION, k=0.2), "w": f(2 * h, k=0.2), "c": np.zeros(1, np.float32)}
        self.p |= {"W": f(DIM, 2 * 3 * h, k=0.3), "U": f(2, 3 * h, h, k=0.3), "b": np.zeros(2 * 3 * h, np.float32)}

    def inputs(self, words: np.ndarray, grams: list[list[int]], keep: np.ndarray | None = None) -> np.ndarray:
        """Vectors of words; where ``keep`` is 0 the word's own vector is left out, as for one never seen."""
        own = self.p["word"][words]
        if keep is not None:
            own = own * keep[:, None]
        if not len(grams):
            return own
        flat, starts, n = _spread(grams)
        return own + np.add.reduceat(self.p["gram"][flat], starts, axis=0) / n[:, None].astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of either direction take from every word: (2 * 3 * HIDDEN, words)."""
        return np.ascontiguousarray((x @ self.p["W"] + self.p["b"]).T, dtype=np.float32)

    def states(self, rows: np.ndarray, mask: np.ndarray | None, table: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States of both directions, (length, 2 * HIDDEN, batch); rows are (batch, length) into the table."""
        batch, length = rows.shape
        h = HIDDEN
        out = np.empty((length, 2 * h, batch), dtype=np.float32)
        state = np.zeros((2, h, batch), dtype=np.float32)
        x = np.empty((2, 3 * h, batch), dtype=np.float32)
        half, u = np.float32(0.5), self.p["U"]
        own = np.ascontiguousarray(rows.T)
        seen = None if mask is None else np.ascontiguousarray(mask.T)
        for s in range(length):
            np.take(table[: 3 * h], own[s], axis=1, out=x[0], mode="clip")
            np.take(table[3 * h :], own[length - 1 - s], axis=1, out=x[1], mode="clip")
            hu = u @ state
            gates = x[:, : 2 * h] + hu[:, : 2 * h]
            squash(gates)
            gates *= half  # gates lie in (0, 1)
            gates += half
            cand = gates[:, h:] * hu[:, 2 * h :]
            cand += x[:, 2 * h :]
            squash(cand)
            new = state - cand
            new *= gates[:, :h]
            new += cand
            if seen is not None:
                new = np.where(np.stack([seen[s], seen[length - 1 - s]])[:, None], new, state)
            if tape is not None:
                tape.append((state, gates, cand, hu[:, 2 * h :]))
            state = new
            out[s, :h] = new[0]
            out[length - 1 - s, h:] = new[1]
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, ...]:
        a = squash(self.p["A"] @ states)
        e = np.einsum("lab,a->lb", a, self.p["v"], optimize=False)
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        s = np.einsum("lb,lhb->hb", e, states, optimize=False)
        return self.p["w"] @ s + self.p["c"][0], s, e, a

    def logits(self, rows: np.ndarray, mask: np.ndarray | None, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.float32)
        for i in range(0, len(rows), 1024):
            m = None if mask is None else mask[i : i + 1024]
            if m is not None and m.all():
                m = None
            out[i : i + 1024] = self.pool(self.states(rows[i : i + 1024], m, table), m)[0]
        return out

    def gradients(self, rows: np.ndarray, mask: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted cross-entropy by every weight but the vectors, and by the inputs x."""
        p, h = self.p, HIDDEN
        batch, length = rows.shape
        tape: list = []
        hs = self.states(rows, mask, self.project(x), tape)
        logit, s, e, a = self.pool(hs, mask)
        g = ((1 / (1 + np.exp(-logit)) - y) * weight).astype(np.float32)
        out = {"w": s @ g, "c": np.array([g.sum()], np.float32)}
        ds = p["w"][:, None] * g
        de = np.einsum("lhb,hb->lb", hs, ds)
        de = e * (de - (e * de).sum(axis=0))
        dhs = e[:, None] * ds
        out["v"] = np.einsum("lab,lb->a", a, de)
        da = de[:, None] * p["v"][:, None] * slope(a)
        out["A"] = np.matmul(da, hs.transpose(0, 2, 1)).sum(axis=0)
        dhs += p["A"].T @ da
        into = np.empty((length, 2, 3 * h, batch), np.float32)  # of the gates' inputs, at the word's place
        out["U"] = np.zeros_like(p["U"])
        carry = np.zeros((2, h, batch), np.float32)
        ut, half = p["U"].transpose(0, 2, 1), np.float32(0.5)
        seen = np.ascontiguousarray(mask.T)
        for k in range(length - 1, -1, -1):
            state, gates, cand, hu = tape[k]
            last = length - 1 - k
            m = np.stack([seen[k], seen[last]])[:, None]
            carry[0] += dhs[k, :h]
            carry[1] += dhs[last, h:]
            dh = np.where(m, carry, 0)
            z, r = gates[:, :h], gates[:, h:]
            dcand = dh * (1 - z) * slope(cand)
            back = np.concatenate([dh * (state - cand) * (half * slope(2 * z - 1)), dcand * hu * (half * slope(2 * r - 1)), dcand], axis=1)
            into[k, 0], into[last, 1] = back[0], back[1]
            back[:, 2 * h :] *= r
            out["U"] += back @ state.transpose(0, 2, 1)
            carry = np.where(m, dh * z + ut @ back, carry)
        flat = np.ascontiguousarray(into.transpose(0, 3, 1, 2)).reshape(length * batch, 2 * 3 * h)
        out["b"] = flat.sum(axis=0)
        word = _sums(rows.T.ravel(), flat, len(x))
        out["W"] = x.T @ word
        return out, word @ p["W"].T


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.rows: dict[str, np.ndarray] = {}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        """One step; of the vectors only the ``rows`` that occurred."""
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, grad in g.items():
            at = self.rows.get(k, slice(None))
            m = self.m[k][at] + 0.1 * (grad - self.m[k][at])
            s = self.s[k][at] + 0.001 * (grad * grad - self.s[k][at])
            self.m[k][at], self.s[k][at] = m, s
            self.p[k][at] -= (self.rate * fix) * m / (np.sqrt(s) + 1e-7)


def _stack(docs: list[np.ndarray], picks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.zeros((len(picks), WINDOW), dtype=np.int64)
    mask = np.zeros((len(picks), WINDOW), dtype=bool)
    for k, (d, start) in enumerate(picks):
        part = docs[d][start : start + WINDOW]
        rows[k, : len(part)] = part
        mask[k, : len(part)] = True
    return rows, mask


class Turns:
    """Draws from a set in random order, everything once before anything comes again."""

    def __init__(self, r: np.random.Generator, values: np.ndarray) -> None:
        self.r, self.values, self.left = r, values, values[:0]

    def __call__(self, n: int) -> np.ndarray:
        while len(self.left) < n:
            self.left = np.concatenate([self.left, self.r.permutation(self.values)])
        out, self.left = self.left[:n], self.left[n:]
        return out


class Sample:
    """Labelled texts as numbers of words, with all their windows."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        words = Words()
        self.y = np.asarray(labels, dtype=np.int64)
        self.docs = [words(tokenize(t)).astype(np.int64) for t in texts]
        own = [set(trigrams(w)) for w in words.plain]
        in_docs, of_grams = np.zeros(len(words.plain), dtype=np.int64), Counter()
        for d in self.docs:
            kinds = np.unique(d)
            in_docs[kinds] += 1
            of_grams.update(set().union(*(own[k] for k in kinds)))
        self.vocabulary = Vocabulary([w for w, n in zip(words.plain, in_docs) if n >= MIN_DOCS], sorted(g for g, n in of_grams.items() if n >= MIN_DOCS))
        self.words, self.grams = self.vocabulary.rows(words.plain)
        self.spans = [(d, s) for d in range(len(self.docs)) for s in windows(len(self.docs[d]))]
        self.rows, self.mask = _stack(self.docs, self.spans)
        r = np.random.default_rng(SEED)
        self.fold = np.full(len(self.y), -1)
        for kind in (0, 1):
            part = np.flatnonzero(self.y == kind)
            self.fold[r.permutation(part)] = np.arange(len(part)) % FOLDS

    def trainable(self, fold: int) -> bool:
        """Whether labels of both kinds lie outside a fold, and the fold holds any."""
        left = self.y[self.fold != fold]
        return len(self.spans) > 0 and len(left) > 0 and left.min() < left.max() and len(left) < len(self.y)


def fitted(sample: Sample, held: np.ndarray, seed: int, rounds: tuple[int, ...]) -> tuple[Network, np.ndarray]:
    """A network trained without the texts held, and its highest logit of every text."""
    docs, y, words, grams, spans, rows, mask = sample.docs, sample.y, sample.words, sample.grams, sample.spans, sample.rows, sample.mask
    r = np.random.default_rng(seed)
    owner = np.array([d for d, _ in spans])
    groups = np.split(np.arange(len(spans)), np.flatnonzero(np.diff(owner)) + 1)
    # log-odds of words between documents, for the first choice of windows
    seen = np.zeros((2, len(words)))
    for d, t in enumerate(docs):
        if not held[d]:
            seen[y[d], np.unique(t)] += 1
    many = [max(1, int(((y == k) & ~held).sum())) for k in (0, 1)]
    odds = np.log((seen[1] + 0.3) / (many[1] + 0.6)) - np.log((seen[0] + 0.3) / (many[0] + 0.6))
    odds[seen[1] < max(2, 0.01 * many[1])] = 0
    value = np.where(mask, np.maximum(odds[rows], 0), 0).sum(axis=1)
    least = SUPPORT  # a labelled text without a window that speaks for its label is taken for a wrong label
    net = Network(seed, len(sample.vocabulary.words), len(sample.vocabulary.grams))
    adam = Adam(net.p, RATE)
    flat, starts, lengths = _spread(grams)
    steps = sum(rounds)
    done = 0
    for some in rounds:
        pos, neg = [], []
        for g in groups:
            d = owner[g[0]]
            if held[d]:
                continue
            ranked = g[np.argsort(-value[g], kind="stable")]
            if not y[d]:
                neg += [*ranked[:HARD], *([int(r.choice(ranked[HARD:]))] if len(g) > HARD else [])]
            elif value[ranked[0]] >= least:
                pos.append(ranked[0])
        if not pos:  # none speaks for its label: all are taken at their word
            pos = [g[np.argmax(value[g])] for g in groups if y[owner[g[0]]] == 1 and not held[owner[g[0]]]]
        if not pos or not neg:
            break
        few = BATCH // 5
        turn = [Turns(r, np.array(x)) for x in (pos, neg)]
        target = np.where(np.arange(BATCH) < few, 0.97, 0.01).astype(np.float32)
        heavy = np.where(np.arange(BATCH) < few, 2.0, 1.0).astype(np.float32) / BATCH
        for _ in range(some):
            adam.rate = RATE * (1 - 0.95 * done / steps)
            done += 1
            pick = np.concatenate([turn[0](few), turn[1](BATCH - few)])
            own_rows, own_mask = rows[pick], mask[pick]
            for j, k in enumerate(pick[:few]):  # the passage may lie anywhere in its window
                d, s = spans[k]
                if len(docs[d]) > WINDOW:
                    s = int(np.clip(s + r.integers(-7, 8), 0, len(docs[d]) - WINDOW))
                    own_rows[j] = docs[d][s : s + WINDOW]
            used, local = np.unique(own_rows, return_inverse=True)
            keep = (r.random(len(used)) > DROP).astype(np.float32)
            n = lengths[used]
            ends = np.cumsum(n)
            of = flat[np.arange(ends[-1]) - np.repeat(ends - n - starts[used], n)]
            own = net.p["word"][words[used]] * keep[:, None]
            x = own + np.add.reduceat(net.p["gram"][of], ends - n, axis=0) / n[:, None].astype(np.float32)
            g, dx = net.gradients(local.reshape(BATCH, WINDOW), own_mask, x, target, heavy)
            for name, at, d in (("word", words[used], dx * keep[:, None]), ("gram", of, np.repeat(dx / n[:, None].astype(np.float32), n, axis=0))):
                ids, where = np.unique(at, return_inverse=True)
                g[name] = _sums(where, d, len(ids))
                if ids[0] == 0:  # the vector of all that have none stays zero
                    g[name][0] = 0
                adam.rows[name] = ids
            adam.step(g)
        value, least = net.logits(rows, mask, net.project(net.inputs(words, grams))), 0.0
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, value)
    return net, best


class Scorer:
    """A trained network with the vectors of all words that a worker has met, and the sample's own cut."""

    def __init__(self, network: Network, vocabulary: Vocabulary, cut: float = 0.0) -> None:
        self.network, self.vocabulary, self.cut = network, vocabulary, cut
        self.words, self.table = Words(), np.zeros((2 * 3 * HIDDEN, 0), np.float32)

    def _grow(self) -> None:
        have, need = self.table.shape[1], len(self.words.plain)
        if need > have:
            fresh = self.network.project(self.network.inputs(*self.vocabulary.rows(self.words.plain[have:])))
            self.table = np.ascontiguousarray(np.concatenate([self.table, fresh], axis=1))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the probability of its highest window, and the number of windows."""
        if len(self.words.plain) > 400_000:
            self.words, self.table = Words(), self.table[:, :0]
        docs = [self.words(tokenize(t)) if t else np.zeros(0, np.int32) for t in texts]
        self._grow()
        counts = np.zeros(len(texts), dtype=np.int64)
        best = np.full(len(texts), -np.inf)
        full: list[np.ndarray] = []
        owner: list[int] = []
        short: list[tuple[int, int]] = []
        for i, d in enumerate(docs):
            starts = windows(len(d))
            counts[i] = len(starts)
            if len(d) >= WINDOW:
                full.append(np.lib.stride_tricks.sliding_window_view(d, WINDOW)[starts])
                owner.append(i)
            elif starts:
                short.append((i, 0))
        if full:
            value = self.network.logits(np.concatenate(full), None, self.table)
            at = np.concatenate([[0], np.cumsum([len(f) for f in full])[:-1]])
            best[owner] = np.maximum.reduceat(value, at)
        if short:
            best[[i for i, _ in short]] = self.network.logits(*_stack(docs, short), self.table)
        return np.where(counts > 0, 1 / (1 + np.exp(-best)), 0.0), counts


def best_cut(score: np.ndarray, y: np.ndarray, weight: float = 1.0) -> float:
    """The logit half-way between the last score taken and the next, where F1 is highest; 0 without a positive label.

    Every clean label counts ``weight`` times.
    """
    if not y.sum():
        return 0.0
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (hit + weight * (np.arange(1, len(order) + 1) - hit) + y.sum())
    k = int(np.argmax(f1))
    low = score[order][k + 1] if k + 1 < len(order) else score[order][k] - 1
    return float((score[order][k] + max(low, -20)) / 2)


def _parts(sample: Sample) -> list[int]:
    """The folds that are scored by a network of their own, and -1 for the network of all labels."""
    return [-1, *(k for k in range(FOLDS) if sample.trainable(k))]


def _held_out(sample: Sample, best: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores by networks that have not seen the label, and the labels."""
    score = np.full(len(sample.y), np.nan)
    for k, own in best.items():
        if k >= 0:
            score[sample.fold == k] = own[sample.fold == k]
    known = ~np.isnan(score)
    return np.maximum(score[known], -20), sample.y[known]


def train(texts: list[str], labels: list[int], *, seed: int = SEED, rounds: tuple[int, ...] = STEPS) -> Scorer | None:
    """A scorer fitted to labelled texts, all in this process, or None without texts of both kinds."""
    if not len(labels) or min(labels) == max(labels):
        return None
    sample = Sample(texts, labels)
    if not sample.spans:
        return None
    done = {k: fitted(sample, sample.fold == k if k >= 0 else np.zeros(len(sample.y), dtype=bool), seed, rounds) for k in _parts(sample)}
    return Scorer(done[-1][0], sample.vocabulary, best_cut(*_held_out(sample, {k: b for k, (_, b) in done.items()})))


def train_on(spark: SparkSession, texts: list[str], labels: list[int]) -> tuple[Scorer, np.ndarray, np.ndarray] | None:
    """A scorer, the held-out scores and their labels; the networks are trained side by side by the workers."""
    if not len(labels) or min(labels) == max(labels):
        return None
    sample = Sample(texts, labels)
    if not sample.spans:
        return None
    shared = spark.sparkContext.broadcast(sample)  # bounded by the limits of the sample
    parts = _parts(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own = shared.value
                net, best = fitted(own, own.fold == k if k >= 0 else np.zeros(len(own.y), dtype=bool), SEED, STEPS)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(net.p) if k < 0 else b""], pa.binary()), pa.array([best.tolist()], pa.list_(pa.float64()))], names=["part", "network", "best"])

    parts_of = spark.range(0, len(parts), 1, len(parts)).select((F.col("id") - 1).alias("part")) if parts == list(range(-1, len(parts) - 1)) else spark.createDataFrame([(k,) for k in parts], "part bigint").repartition(len(parts))
    rows = parts_of.mapInArrow(run, "part bigint, network binary, best array<double>").collect()  # one row for each of FOLDS + 1 networks
    network = Network()
    network.p = pickle.loads(next(r.network for r in rows if r.part < 0))
    score, y = _held_out(sample, {r.part: np.array(r.best) for r in rows})
    return Scorer(network, sample.vocabulary, best_cut(score, y)), score, y


def labelled(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded sample of documents whose labels agree."""
    agreed = labels.filter("abusive is not null").groupBy("doc_id").agg(F.min("abusive").alias("low"), F.max("abusive").alias("top")).filter("low = top and top in (0, 1)")
    kinds = [agreed.filter(F.col("top") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "top") for kind, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    sample = kinds[0].unionByName(kinds[1])
    rows = documents.select("doc_id", "text").filter(f"text is not null and length(text) between 1 and {MAX_CHARS}").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).collect()  # bounded by the limits above
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.top for r in rows]


def scored(documents: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, score in [0, 1], number of windows and flag of every document."""
    spark = documents.sparkSession
    model = train_on(spark, *labelled(documents, labels))
    shared = spark.sparkContext.broadcast((model[0].network.p, model[0].vocabulary) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if shared.value:
            network = Network()
            network.p = dict(shared.value[0])
            scorer = Scorer(network, shared.value[1])
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            score, n = (np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)) if scorer is None else scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(score), pa.array(n)], names=[*keep, "score", "windows"])

    rows = documents.select(*keep, F.col("text").alias("__text"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double, windows bigint")
    if not model:
        return out.withColumn("abusive", F.lit(False))
    scorer, score, y = model
    out = materialize(out, "scores")
    n, above = out.agg(F.count("*"), F.count_if((F.col("score") >= _chance(scorer.cut)) & (F.col("windows") > 0))).first()
    share = min(max(above / max(n, 1), 1 / (n + 2)), 1 - 1 / (n + 2))
    weight = (1 - share) / share * y.sum() / max(1, (y == 0).sum())
    cut = best_cut(score, y, weight)
    return out.withColumn("abusive", (F.col("score") >= _chance(cut)) & (F.col("windows") > 0))


def _chance(logit: float) -> float:
    return float(1 / (1 + np.exp(-logit)))
