"""Problems 2, 3, 6, 7 and 8: pairs, pieces, bins, mixtures and scores."""

from __future__ import annotations

import ast
import os
import random
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import abuse, mixing, near_duplicates, packing, splitting, tokens


def shingles(t, k=3):
    w = near_duplicates.words(t or "")
    return set(zip(*(w[j:] for j in range(k))))


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(5)
    rows = []
    for g in range(25):
        base = [f"p{r.randrange(3000)}" for _ in range(60)]
        for _ in range(4):
            own = list(base)
            for _ in range(r.randrange(0, 14)):
                own[r.randrange(len(own))] = f"q{r.randrange(3000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, rows[0][1]), (901, rows[0][1] + "  "), (902, None), (903, ""), (904, "curto demais"), (905, " ".join(f"w{i}" for i in range(60_000))), (906, rows[0][1].upper())]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "k bigint, t string, id string, n int")
    sets = {i: shingles(t) for i, t in rows if len(shingles(t)) >= 30}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    pairs = near_duplicates.similar_pairs(df, "k", "t", shingle=3, threshold=0.5, min_shingles=30)
    got = {(p.id_a, p.id_b) for p in pairs.collect()}
    assert got == want and len(want) > 40
    groups = {p.id: p.group_id for p in near_duplicates.duplicate_groups(pairs).collect()}
    assert all(groups[a] == groups[b] for a, b in want) and set(groups) == {x for p in want for x in p}
    direct = {p.id: p.group_id for p in near_duplicates.near_duplicate_groups(df, "k", "t", shingle=3, threshold=0.5, min_shingles=30).collect()}
    assert direct == groups  # pairs between sets and membership give the same groups as all pairs


def test_many_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES_A_BLOCK", 3)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40 + (i >= 20)))) for i in range(23)], "k bigint, t string")
    got = [(p.id_a, p.id_b) for p in near_duplicates.similar_pairs(df, "k", "t").collect()]
    assert sorted(got) == [(a, b) for a in range(23) for b in range(a + 1, 23)]


def test_recall_of_bands():
    # at the threshold of 0.5 a pair shares no band with probability (1 - 0.5 ** ROWS) ** (M / ROWS)
    r = np.random.default_rng(1)
    n, rows = 1200, near_duplicates.ROWS
    core = r.integers(0, 2**63, (n, 40), dtype=np.uint64)
    rest = r.integers(0, 2**63, (2, n, 20), dtype=np.uint64)
    sketches = [near_duplicates.registers(np.sort(np.concatenate([core, rest[k]], axis=1), axis=1).ravel(), np.arange(n + 1) * 60) for k in (0, 1)]
    equal = (sketches[0] == sketches[1]).reshape(n, -1, rows).all(axis=2).any(axis=1)
    assert equal.mean() > 0.995


def test_shared_phrases_make_few_candidates(spark, monkeypatch):
    # texts that share stock sentences meet in some band by chance; few of them may leave the join
    r = random.Random(11)
    stock = [" ".join(f"s{k}_{j}" for j in range(12)) for k in range(10)]
    rows = [(i, " ".join([*r.sample(stock, 3), *(f"w{i}_{j}" for j in range(60))])) for i in range(800)]
    rows += [(1000 + i, rows[i][1].replace(f"w{i}_20", "outra")) for i in range(40)]
    counts, made = {}, near_duplicates.Scratch.table

    def counted(self, df, label, partitions=None):
        out = made(self, df, label, partitions)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(near_duplicates.Scratch, "table", counted)
    df = spark.createDataFrame(rows, "k bigint, t string")
    got = {(p.id_a, p.id_b) for p in near_duplicates.similar_pairs(df, "k", "t", shingle=3, threshold=0.5, min_shingles=30).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])} and len(got) >= 40
    assert counts["found"] < 2_000  # of 352,380 pairs


def test_signatures_keep_pairs_at_the_threshold():
    r = np.random.default_rng(2)
    n = 3000
    core, rest = r.integers(0, 2**63, (n, 40), dtype=np.uint64), r.integers(0, 2**63, (2, n, 20), dtype=np.uint64)
    a, b = (near_duplicates.signatures(near_duplicates.registers(np.concatenate([core, rest[k]], axis=1).ravel(), np.arange(n + 1) * 60)) for k in (0, 1))

    def differ(x, y):
        half = x.shape[1] // 2
        x = x ^ y
        return np.bitwise_count((x[:, :half] | x[:, half:]).view(np.uint64)).sum(axis=1)

    limit = near_duplicates.most_different(0.5)
    assert (differ(a, b) <= limit).all()
    assert (differ(a[1:], b[:-1]) <= limit).mean() < 0.002  # strangers


def test_pairs_come_once_where_ids_repeat(spark):
    text = " ".join(f"w{j}" for j in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text + " fim"), (3, text), (3, text)], "k bigint, t string")
    assert sorted((p.id_a, p.id_b) for p in near_duplicates.similar_pairs(df, "k", "t").collect()) == [(1, 2), (1, 3), (2, 3)]


def test_shuffle_files_go_with_their_step(spark):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before = files()
    with near_duplicates.Scratch(spark) as tables:
        tables.table(spark.range(100_000).groupBy((F.col("id") % 5000).alias("x")).count(), "step")
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.2)
        assert not files() - before


def test_near_duplicates_empty(spark):
    assert near_duplicates.similar_pairs(spark.createDataFrame([], "k bigint, t string"), "k", "t").count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(2))
    b[:200] = a[:200]
    union = np.unique(np.concatenate([a, b]))
    one = lambda x: near_duplicates.registers(x, np.array([0, len(x)]))
    assert (near_duplicates.merge(one(a), one(b)) == one(union)).all()
    assert abs(near_duplicates.jaccard_by_likelihood(one(a), one(b), np.array([400.0]), np.array([400.0]))[0] - 1 / 3) < 0.15


def test_groups_of_a_long_chain(spark):
    # the ids fall towards the far end, whose label the smallest id meets everywhere
    ids = [0, *range(150, 1, -1), 1]
    pairs = spark.createDataFrame([(min(p), max(p), 1.0) for p in zip(ids, ids[1:])] + [(900, 901, 1.0)], "id_a bigint, id_b bigint, jaccard double")
    got = {r.id: r.group_id for r in near_duplicates.duplicate_groups(pairs).collect()}
    assert got == {**dict.fromkeys(range(151), 0), 900: 900, 901: 900}


def test_split_texts_round_trip(spark):
    r = random.Random(2)
    make = lambda n: "".join(r.choice(["palavra", "fim. ", "\n\n", " ", "\n", "é", "x"]) for _ in range(n))
    rows = [(1, make(500), 100, 20), (2, "a" * 250, 100, 10), (3, "b" * 100, 100, 10), (4, None, 100, 1), (5, "", 100, 1), (6, "c" * 101, 100, 500), (7, make(9), None, 1), (8, make(40_000), 2000, 150), (8, "d" * 150, 100, 0)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "k bigint, t string, cap int, lap int, text string")
    got = splitting.split_texts(df, "k", "t", "cap", "lap").collect()
    assert {p.item_id for p in got} == {1, 2, 6, 8}
    for k, t, cap, lap in rows[:8]:
        own = sorted((p for p in got if p.item_id == k), key=lambda p: p.piece_no)
        own = [p for p in own if k != 8 or p.piece != "d" * len(p.piece)]
        if own:
            assert "".join(p.piece[p.overlap :] for p in own) == t and all(len(p.piece) <= cap and t[p.start : p.end] == p.piece for p in own)
            assert all(p.overlap == min(lap, cap - 1) for p in own[1:])


def test_split_at_best_boundary():
    text = "Um dois. Três quatro\n\ncinco seis sete oito nove dez onze doze treze"
    assert text[: splitting.split_text(text, 30, 0)[0][1]] == "Um dois. Três quatro\n\n"
    ranged = [splitting.boundaries(text, lo, min(lo + 7, len(text))) for lo in range(0, len(text), 7)]
    assert np.concatenate([x[0] for x in ranged]).tolist() == splitting.boundaries(text)[0].tolist()
    assert np.concatenate([x[1] for x in ranged]).tolist() == splitting.boundaries(text)[1].tolist()


def test_split_matches(spark):
    order, pieces = splitting.split_matches([(5, 9), (0, 3), (6, 2), (None, 1), (20, 1)], 2, 0)
    assert order == [1, 0, 2, 4, 3] and [p[:2] for p in pieces] == [(0, 1), (1, 3), (3, 5)]
    m = "array<struct<offset:bigint,length:bigint>>"
    df = spark.createDataFrame([(1, [(i, 1) for i in range(9)], 4, 1), (2, None, 4, 1), (3, [], 4, 1), (4, [(0, 1)] * 4, 4, 1)], f"k bigint, m {m}, cap int, lap int")
    got = splitting.split_match_lists(df, "k", "m", "cap", "lap").orderBy("piece_no").collect()
    assert [(p.item_id, p.order) for p in got] == [(1, [0, 1, 2, 3]), (1, [3, 4, 5, 6]), (1, [6, 7, 8])]


def test_split_files(spark, tmp_path):
    r = random.Random(3)
    text = "".join(r.choice(["palavra", "ção", "fim. ", "\n\n", " ", "𝔘", "\n"]) for _ in range(6000))
    path = str(tmp_path / "a.txt")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    raw = text.encode()
    got = splitting.split_files(spark, [(path, os.path.getsize(path)), (str(tmp_path / "none"), 0)], 400, 30, range_bytes=1500, segment=4).orderBy("start").collect()
    assert all(text[p.start : p.end] == p.piece == raw[p.first_byte : p.past_byte].decode() and len(p.piece) <= 400 for p in got)
    assert got[0].start == 0 and got[-1].end == len(text) and {a.end - b.start for a, b in zip(got, got[1:])} == {30}


def test_pieces_are_the_same_for_any_range(spark, tmp_path):
    r = random.Random(9)
    bits = ["palavra ", "ção", "fim. ", "\n\n", " " * 700, "𝔘", "\n", "x" * 900, "»\n\n"]
    text = "".join(r.choices(bits, weights=[30, 10, 5, 1, 0.2, 5, 2, 0.3, 1], k=4000))
    want = splitting.split_text(text, 350, 40, range_bytes=1 << 30)
    assert all(splitting.split_text(text, 350, 40, range_bytes=n) == want for n in (7, 64, 1000, 8192))
    assert [text[a:b] for a, b, _ in want] == [p[3] for p in splitting.split_cell(text.encode(), 350, 40, range_bytes=500)]
    path = str(tmp_path / "b.txt")
    Path(path).write_bytes(text.encode())
    for size, segment in ((1024, 2), (4096, 3), (1 << 20, 16)):
        got = splitting.split_files(spark, [(path, os.path.getsize(path))], 350, 40, range_bytes=size, segment=segment).orderBy("start").collect()
        assert [(p.start, p.end, p.piece) for p in got] == [(a, b, text[a:b]) for a, b, _ in want]


def test_packing(spark):
    assert packing.fullest([7, 5, 3], {7: 1, 5: 2, 3: 1}, 13) == {5: 2, 3: 1}
    r = random.Random(4)
    sizes = [r.randint(1, 40) for _ in range(300)] + [250, 100, 0, None, 7, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    got = packing.pack(df, {"a": 100, "b": 64}).collect()
    for name, cap in (("a", 100), ("b", 64)):
        own = [p for p in got if p.container == name]
        bins = {}
        for p in own:
            bins.setdefault(p.bin_id, []).append(p.tokens)
        assert all(sum(b) <= cap for k, b in bins.items()) and sum(p.tokens for p in own) == sum(x or 0 for x in sizes)
        assert all(p.bin_tokens == sum(bins[p.bin_id]) for p in own) and {p.doc_id for p in own} == set(range(len(sizes)))
        assert all(len([p for p in own if p.doc_id == k]) == max(1, -(-(x or 0) // cap)) for k, x in enumerate(sizes))
        assert len(bins) - (0 in bins) <= -(-sum(x or 0 for x in sizes) // cap) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), {"a": 9}).count() == 0


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, r.choice("aaaaaabbc"), r.randint(1, 50)) for i in range(3000)] + [(9001, None, 9), (9002, "zz", 9), (9003, "a", 0), (9004, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = [{"source": s, "target_share": w, "max_repeats": m} for s, w, m in (("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.25, 3), ("none", 0.05, 3))]
    got = mixing.mix(docs, targets).collect()
    total = sum(p.n_tokens for p in got)
    for t in targets[:3]:
        own = [p for p in got if p.source == t["source"]]
        assert abs(sum(p.n_tokens for p in own) / total - t["target_share"] / 0.95) < 0.01 and max(p.copy for p in own) <= t["max_repeats"]
    assert [p.position for p in got] == sorted(p.position for p in got) and 0 < got[0].position and got[-1].position <= 1 and not {p.doc_id for p in got} & {9001, 9002, 9003, 9004}
    report = {p.source: p for p in mixing.shares(docs, targets).collect()}
    assert report["none"].tokens == 0 and abs(sum(p.reached_share for p in report.values()) - 1) < 1e-9
    assert mixing.mix(spark.createDataFrame([], docs.schema), targets).count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_tokens(spark):
    counter = tokens.Counter(tokens.ranks())
    for t in ("Olá, mundo!  \n\n dois\t3½", "", "não é  aqui's   ", "x" * 5000):
        assert counter.count(t) == len(counter.encoding.encode_ordinary(t))
    df = spark.createDataFrame([(1, None), (2, "a b"), (2, "a b")], "k bigint, n_tokens string")
    assert sorted(r.n_tokens for r in tokens.token_counts(df.withColumnRenamed("n_tokens", "t"), "t", "k").collect()) == [0, 2, 2]


def test_abuse(spark):
    r = random.Random(8)
    calm = "o antigo mosteiro recebeu a crônica do conselho segundo a tradição e fundou outra cidade perto do rio".split()
    rude = ["você é um idiota nojento", "cala a boca seu canalha", "some daqui verme imundo", "vou te matar imbecil"]
    make = lambda bad: " ".join(r.choice(calm) for _ in range(40)) + (" " + r.choice(rude) if bad else "") + " " + " ".join(r.choice(calm) for _ in range(20))
    rows = [(i, make(i % 4 == 0)) for i in range(260)] + [(901, None), (902, ""), (903, "Seu i d i o t a n0j3nt0!"), (904, "o conselho " * 30_000), (905, make(False)), (905, make(False))]
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(200, 1), (200, 0), (201, None)], "doc_id bigint, abusive int")
    got = {p.doc_id: p for p in abuse.scored(docs, labels, "doc_id", "source").collect()}
    held = range(204, 260)
    right = sum(got[i].abusive == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert (got[901].score, got[901].windows, got[901].abusive) == (0.0, 0, False) and got[902].windows == 0 and got[904].windows > 1000 and not got[904].abusive
    none = abuse.scored(docs, labels.filter("abusive = 0"), "doc_id").filter("score > 0 or abusive").count()
    assert none == 0 and abuse.plain("CRÉTÍÍÍÍNO") == "cretino" and abuse.tokenize("c.a.n.a.l.h.a") == ["canalha"]


def test_abuse_threshold_from_texts_not_trained_on(monkeypatch):
    r = random.Random(3)
    calm = "o antigo mosteiro recebeu a crônica do conselho segundo a tradição e fundou outra cidade perto do rio".split()
    make = lambda bad: " ".join(r.choice(calm) for _ in range(30)) + (" seu canalha imundo " if bad else " ") + " ".join(r.choice(calm) for _ in range(9))
    asked = []
    cut = abuse.best_cut
    monkeypatch.setattr(abuse, "best_cut", lambda score, y: asked.append((len(y), int(y.sum()))) or cut(score, y))
    for n in (12, 120, 480):  # the same rule for few labels and many
        assert abuse.train([make(i % 4 == 0) for i in range(n)], [int(i % 4 == 0) for i in range(n)], rounds=(1,)) is not None
    assert asked == [(n, n // 4) for n in (12, 120, 480)]
    assert cut(np.array([3.0, 1.0, 0.5, -2.0]), np.array([1, 1, 0, 0])) == 0.75 and cut(np.array([1.0]), np.array([0])) == 0.0


def test_no_words_are_given_to_the_network():
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    corpus = "\n".join(t.lower() for t in pq.read_table(folder, columns=["text"])["text"].to_pylist() if t)
    tree = ast.parse(Path(abuse.__file__).read_text())
    literals = {n.value.lower().strip() for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    assert not [x for x in literals if len(x.split()) >= 2 and x in corpus]


def test_abuse_cut_follows_the_share_in_the_corpus():
    score, y = np.array([5.0, 4.0, 3.0, 2.0, 1.0, 0.5, -3.0, -4.0]), np.array([1, 1, 0, 1, 1, 0, 0, 0])
    assert abuse.best_cut(score, y) == 0.75 and abuse.best_cut(score, y, 8.0) == 3.5
    assert abuse.train(["a b", "", " ", "c d"], [1, 0, 0, 0]) is not None and abuse.train(["", " "], [1, 0]) is None and abuse.train([], []) is None


def test_gradients():
    net = abuse.Network(1)
    r = np.random.default_rng(2)
    rows = r.integers(0, 9, (3, abuse.WINDOW))
    mask = np.ones_like(rows, dtype=bool)
    mask[1, 10:] = False
    x, y, w = r.standard_normal((9, abuse.DIM)).astype(np.float32), np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss(xs):
        z = net.logits(rows, mask, net.project(xs)).astype(float)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    g, dx = net.gradients(rows, mask, x, y, w)
    for i, j in ((0, 0), (4, 3), (8, 7)):
        up, down = x.copy(), x.copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - dx[i, j]) < 2e-2 * max(1, abs(dx[i, j]))
