import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lodespark.llm import hpy, quality
from lodespark.sources.shared import shuffled

DOCS = "doc_id long, text string"


def good(rng):
    return " ".join(rng.choice(["the", "house", "stands", "by", "a", "river", "and", "trees", "grow", "there"]) for _ in range(rng.randrange(20, 200))) + "."


def junk(rng):
    return " ".join(rng.choice(["$$$", "BUY!!", "click", "###", "WIN!!", "now", "a"]) for _ in range(rng.randrange(20, 200)))


def test_quality_on_held_out(spark):
    rng = random.Random(2)
    rows = [(k, good(rng) if k % 5 else junk(rng)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(300)] + [(301, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, " \n"), (None, "a"), (3, rows[3][1])], DOCS).selectExpr("doc_id", "text", "1 AS keep", "0 AS quality", "5 AS y")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 604
    for r in got:
        if r.doc_id >= 1000:
            assert r.p_quality == 0 and not r.keep
        elif r.doc_id >= 300:
            assert r.keep == (r.doc_id % 5 > 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 1000").count() == 0
    assert {r.doc_id for r in kept.collect()} - {None} == {r.doc_id for r in got if r.keep}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.p_quality for r in quality.quality_scores(docs, labels).collect()] == [1.0, 1.0]
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_toxic_documents_of_good_quality_are_rejected(spark):
    rng = random.Random(12)
    rows = []
    for k in range(600):
        w = good(rng).split()
        if k % 6 == 0:  # few words among many, once each
            for bad in rng.sample(["zounds", "knave", "varlet"], 2):
                w.insert(rng.randrange(len(w)), bad)
        rows.append((k, " ".join(w)))
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(400)] + [(6, 1, 0), (401, None, 0), (402, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = [k for k in range(600) if k > 402]
    assert all(got[k].keep == (k % 6 > 0) and got[k].keep == (got[k].p_toxic < quality.TOXIC_FROM) for k in held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if got[k].keep}


def test_scores_follow_the_definition():
    rng = np.random.default_rng(0)
    w = rng.normal(size=1 << quality.BITS).astype(np.float32)
    texts = ["one two three", "x", "", "ünï cödé " * 50, "a" * 100_000]
    together = quality.raw_scores(pa.array(texts), w, 0.5)
    alone = [quality.raw_scores(pa.array([t]), w, 0.5)[0] for t in texts]
    assert np.allclose(together, alone, equal_nan=True) and np.isnan(together[2])
    # doubled text keeps its shares, but for the n-grams at the seam
    a, b = quality.raw_scores(pa.array(["ab cd " * 3000, "ab cd " * 6000]), w, 0.0)
    assert abs(a - b) < 0.01


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(size=20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float)
    slope, shift = quality._platt(z, y)
    assert abs(slope - 0.7) < 0.05 and abs(shift + 0.4) < 0.05


def test_history_is_the_words_before():
    w, back, doc = hpy.history(pa.array(["a b c d", "", "b", " a  b\n"]), 3)
    a, b, c, d = w[:4].tolist()
    assert w.tolist() == [a, b, c, d, b, a, b] and doc.tolist() == [0, 0, 0, 0, 2, 3, 3]
    assert back[0].tolist() == [0, a, b, c, 0, 0, a] and back[1].tolist() == [0, 0, a, b, 0, 0, 0]


@pytest.mark.parametrize("c,p", [(2, 0.3), (5, 0.2), (16, 0.2), (12, 0.9)])
def test_seating_has_the_exact_conditional(c, p):
    """Tables of one dish, against P(t) ~ S_d(c, t) p^t (theta|d)_t; table sizes add up to the customers."""
    rng, d, s, n = np.random.default_rng(c), 0.8, 1.0, 8000
    ways = {1: 1.0}
    for k in range(1, c):
        nxt = Counter()
        for t, v in ways.items():
            nxt[t] += v * (k - d * t)
            nxt[t + 1] += v
        ways = nxt
    chance = {t: v * p**t * math.prod(s + d * k for k in range(t)) for t, v in ways.items()}
    z = sum(chance.values())
    seats = hpy.Seats(np.full(n, c), d, rng)
    seats.fill(np.full(n, c), np.full(n, p))
    for _ in range(40):
        seats.sweep(d * rng.gamma(s / d + seats.t) * p, moves=16)
    for t, v in chance.items():
        assert abs((seats.t == t).mean() - v / z) < 0.025
    seats.bring(np.full(n, c - 1), np.full(n, p))
    sizes = seats.size.reshape(n, c)
    assert (sizes.sum(axis=1) == c - 1).all() and ((sizes > 0).sum(axis=1) == seats.t).all() and (seats.c == c - 1).all()
    seats.bring(np.full(n, c), np.full(n, p))
    assert (seats.size.reshape(n, c).sum(axis=1) == c).all()


def test_tables_are_drawn_by_their_sizes():
    """Two dishes side by side, of customers at tables of sizes 3, 1, 1 and 2, 4: weights size - d."""
    n, d = 30_000, 0.8
    seats = hpy.Seats(np.tile([5, 6], n), d, np.random.default_rng(2))
    seats.tab[:] = np.tile([0, 3, 0, 4, 0, 1, 1, 0, 1, 0, 1], n)
    seats.size[:] = np.tile([3, 0, 0, 1, 1, 2, 4, 0, 0, 0, 0], n)
    got = (seats.drawn(seats.at[:-1], np.tile([5, 6], n)) - seats.at[:-1]).reshape(n, 2)
    for k, want in enumerate([{0: 2.2 / 2.6, 3: 0.2 / 2.6, 4: 0.2 / 2.6}, {0: 1.2 / 4.4, 1: 3.2 / 4.4}]):
        assert set(got[:, k].tolist()) == set(want)
        assert all(abs((got[:, k] == t).mean() - p) < 0.01 for t, p in want.items())


def test_large_dishes_keep_their_places():
    """Dishes too large to be listed at once, beside small ones: no two tables at a place, none lost."""
    rng = np.random.default_rng(4)
    c = np.array([1, 2, 3, 150_000, 7])
    seats = hpy.Seats(c, 0.8, rng)
    seats.fill(c, np.full(5, 50.0))
    for _ in range(3):
        seats.sweep(np.full(5, 1e6), moves=200)
        seats.bring(np.maximum(1, c - 1), np.full(5, 50.0))
        seats.bring(c, np.full(5, 50.0))
        for k, n in enumerate(c):
            tab, size = seats.tab[seats.at[k] : seats.at[k] + n], seats.size[seats.at[k] : seats.at[k + 1]]
            assert (np.bincount(tab, minlength=n) == size).all() and (size > 0).sum() == seats.t[k]


def tables_by_recursion(c, new, d=0.5):
    """P(t) ~ S_d(c, t) new^t of one dish."""
    ways = np.array([0.0, 1.0])
    for k in range(1, c):
        nxt = np.zeros(len(ways) + 1)
        nxt[:-1] += ways * (k - d * np.arange(len(ways)))
        nxt[1:] += ways
        ways = nxt / nxt.sum()
    p = ways * float(new) ** np.arange(len(ways))
    return p / p.sum()


def test_root_seats_all_customers_of_large_dishes():
    """Half of the dishes have one customer, and so one table, half have 400, more than the 64 that were once seated."""
    n = 2000
    root = hpy.Root(np.arange(n, dtype=np.uint64), np.zeros(0), np.arange(n), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    customers = np.repeat([1, 400], n // 2)
    p = hpy.seated_root(root, customers, np.random.default_rng(1), sweeps=60).p * (1 + customers.sum())
    got = 1 + 2 * (399 - (p[n // 2 :].mean() - p[: n // 2].mean()))
    want = 1.0
    for _ in range(100):  # the weight of a new table follows from the number of tables
        want = float(tables_by_recursion(400, 0.25 * (1 + want)) @ np.arange(401))
    assert abs(got - want) < 0.05 * want and abs(p.sum() - (1 + customers.sum())) < 1e-6 * p.sum()


@pytest.mark.parametrize("c,new", [(1, 2.0), (2, 0.3), (90, 0.01), (90, 5.0), (90, 400.0)])
def test_root_tables_have_the_exact_conditional(c, new):
    n = 20_000
    t = hpy.root_tables(np.full(n, c), np.full(n, new), np.random.default_rng(c))
    assert np.abs(np.bincount(t, minlength=c + 1) / n - tables_by_recursion(c, new)).max() < 0.015
    assert hpy.root_tables(np.array([0, 10**9]), np.array([1.0, 1.0]), np.random.default_rng(1)).tolist()[0] == 0


def test_predictions_sum_to_one():
    rng = np.random.default_rng(5)
    voc = hpy.mix(np.arange(1, 41, dtype=np.uint64))
    seq = voc[rng.zipf(1.5, 5000) % 40]
    back = np.stack([np.roll(seq, 1), np.roll(seq, 2)])
    rest = np.bincount((voc[30:] & np.uint64(3)).astype(int), minlength=4)
    root = hpy.Root(np.sort(voc[:30]), hpy.first_of(np.sort(voc[:30])), np.arange(30), rest, np.array([1, 3] * 8, np.int32), np.zeros(0))
    root = hpy.seated_root(root._replace(p=root.base()), rng.integers(0, 9000, 34), rng)
    every = np.array([*voc, *range(4)], np.uint64)  # 0 to 3: the unknown words of the classes
    for ctx in ((voc[0], voc[1]), (voc[0], 5), (7, 5), (0, 0)):
        w = np.concatenate([seq, every])
        b = np.concatenate([back, np.repeat(np.array(ctx, np.uint64)[:, None], len(every), axis=1)], axis=1)
        lv, mine = hpy.levels(w, b, np.arange(len(w)) < len(seq), root)
        p, _ = hpy.sample(lv, root, 1, 2, np.random.default_rng(3))
        assert abs(p[mine][len(seq) :].sum() - 1) < 1e-9


class Plain:
    """A hierarchical Pitman-Yor model seated customer by customer, for comparison."""

    def __init__(self, docs, rng):
        self.rng, self.vocab = rng, sorted({w for d in docs for w in d})
        self.tables = {}  # (context, word) -> sizes of tables
        self.sums = {}  # context -> customers, tables
        self.seats = [(w, tuple(([None, None] + d)[i : i + 2][::-1])) for d in docs for i, w in enumerate(d)]

    def p(self, ctx, w):
        if ctx is None:
            return 1 / (len(self.vocab) + hpy.CLASSES)
        c, t = self.sums.get(ctx, (0, 0))
        own, d = self.tables.get((ctx, w), []), hpy.DISCOUNT[len(ctx)]
        return (sum(own) - d * len(own) + (1 + d * t) * self.p(ctx[:-1] if ctx else None, w)) / (1 + c)

    def move(self, ctx, w, by):
        if ctx is None:
            return
        own, d = self.tables.setdefault((ctx, w), []), hpy.DISCOUNT[len(ctx)]
        c, t = self.sums.get(ctx, (0, 0))
        up = ctx[:-1] if ctx else None
        if by > 0:
            weights = [n - d for n in own] + [(1 + d * t) * self.p(up, w)]
            k = self.rng.choices(range(len(weights)), weights)[0]
            if k == len(own):
                own.append(0)
                self.move(up, w, 1)
                t += 1
            own[k] += 1
        else:
            k = self.rng.choices(range(len(own)), own)[0]
            own[k] -= 1
            if not own[k]:
                own.pop(k)
                self.move(up, w, -1)
                t -= 1
        self.sums[ctx] = (c + by, t)

    def run(self, burn_in, kept):
        for w, ctx in self.seats:
            self.move(ctx, w, 1)
        mean = [0.0] * len(self.seats)
        for k in range(burn_in + kept):
            for w, ctx in self.seats:
                self.move(ctx, w, -1)
                self.move(ctx, w, 1)
            if k >= burn_in:
                mean = [m + self.p(ctx, w) / kept for m, (w, ctx) in zip(mean, self.seats, strict=True)]
        return mean


def test_scores_equal_a_model_seated_customer_by_customer(spark, monkeypatch):
    rng = random.Random(4)
    docs = [[rng.choice(["the", "a"]) if k % 2 else rng.choice(["cat", "dog", "house", "tree", f"x{rng.randrange(40)}"]) for k in range(rng.randrange(5, 30))] for _ in range(40)]
    docs += docs[:6]
    mean = Plain(docs, rng).run(20, 60)
    want, at = [], 0
    for d in docs:
        want.append(sum(map(math.log, mean[at : at + len(d)])) / len(d))
        at += len(d)
    monkeypatch.setattr(hpy, "KEPT", 30)
    got = sorted(tuple(r) for r in hpy.score(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], DOCS)).collect())
    assert [r[:2] for r in got] == [(k, len(d)) for k, d in enumerate(docs)]
    gap = np.array([r[2] for r in got]) - want
    assert abs(gap.mean()) < 0.05 and np.abs(gap).max() < 0.25
    assert all(abs(r[3] - math.exp(-r[2])) < 1e-3 * r[3] for r in got)
    once, twice = [r[2] for r in got[6:40]], [r[2] for r in got[:6]]
    assert np.mean(twice) > np.mean(once) + 0.1


def test_scores_of_edge_cases(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(40))) for k in range(30)]
    rows += [(200, "zq!7 XK%%% 09 vvv " * 5), (201, None), (202, ""), (203, " \n"), (None, "alpha"), (0, rows[0][1]), (0, "alpha"), (204, "la " * 70_000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS lp", "2 AS bucket", "'x' AS key")
    monkeypatch.setattr(hpy, "CONTEXT_TOKENS", 50)  # contexts told apart by classes
    monkeypatch.setattr(hpy, "SLICE_TOKENS", 300)
    monkeypatch.setattr(hpy, "TOP_WORDS", 2)
    own = sorted(tuple(r) for r in hpy.score(docs).collect())
    assert len(own) == len(rows) - 1 and own[0][:2] == (0, 1) and own[1] == own[2]
    by = {r[0]: r for r in own}
    assert by[201][1:] == by[202][1:] == by[203][1:] == (0, None, None) and by[204][1] == 70_000 and by[204][3] < 2
    other = {r.doc_id: r for r in hpy.score(docs.filter("doc_id >= 200"), docs.filter("doc_id BETWEEN 1 AND 29")).collect()}
    assert len(other) == 5 and other[200].perplexity > 100 and other[201].perplexity is None
    held = hpy.score(docs.filter("doc_id BETWEEN 20 AND 29"), docs.filter("doc_id BETWEEN 1 AND 19")).collect()
    assert len(held) == 10 and max(r.perplexity for r in held) < 8
    assert hpy.score(docs.limit(0)).count() == 0 and hpy.score(docs.filter("doc_id = 201"), docs.limit(0)).first().n_words == 0


@pytest.mark.parametrize("n,most", [(1, 30.0), (7, 30.0), (50, 3e9)])
def test_sums_are_packed_small_and_whole(n, most):
    rng = np.random.default_rng(n)
    key = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 20_000), [-(2**63), -1, 0, 2**63 - 1]]))
    key = key[rng.permutation(len(key))]
    cost, words, rows = rng.random(len(key)) * most, 1 + rng.poisson(2.0, len(key)), rng.poisson(0.01, len(key))
    cost[:2], words[0], rows[1] = (0, most), 70_000, 300
    got = hpy._sums(key, cost, words, rows, n)
    back = [hpy._summed(k, x.as_buffer(), n) for k, x in zip(got.column(0).to_pylist(), got.column(1), strict=True)]
    k, c, w, r = (np.concatenate(x) for x in zip(*back, strict=True))
    at, own = np.argsort(k), np.argsort(key)
    assert (k[at] == key[own]).all() and (w[at] == words[own]).all() and (r[at] == rows[own]).all()
    assert np.abs(c[at] - cost[own]).max() <= max(hpy.UNIT, np.spacing(most)) / 2
    if most < 1e9:  # 24 bytes a row before
        assert sum(len(pa.Codec("lz4_raw").compress(x.as_py(), asbytes=True)) for x in got.column(1)) < 15.5 * len(key)


def test_both_rounds_read_one_shuffle(spark, monkeypatch):
    made = []
    postings = hpy._postings
    monkeypatch.setattr(hpy, "_postings", lambda *a: made.append(a) or postings(*a))
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30))) for k in range(20)], DOCS)
    assert hpy.score(docs).count() == 20 and len(made) == 1
    assert hpy.score(docs.filter("doc_id < 5"), docs.filter("doc_id >= 5")).count() == 5 and len(made) == 3


def test_a_shuffle_is_written_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = shuffled(spark.range(100).mapInArrow(run, "id long").repartition(5, "id"))
    assert df.count() == 100 and df.filter("id < 10").count() == 10 and df.agg({"id": "sum"}).first()[0] == 4950
    assert seen.value == 100
