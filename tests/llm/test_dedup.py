import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodespark.llm import jaccard, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, words, rate):
    return [f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def brute_links(rows, n=3, t=0.5):
    """Places in rows of all linked pairs, with their Jaccard."""
    sets = []
    for i, text in rows:
        w = (text or "").lower().split()
        sets.append(({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if i is not None and w else set())
    out = {}
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= t:
                out[b, a] = both / len(sets[a] | sets[b])
    return out


def brute_classes(rows, links):
    """(doc_id, class_id, n_links) of each row that has a link, and the class of each row."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(b)] = find(a)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    n = Counter(x for pair in links for x in pair)
    return sorted((rows[k][0], min(rows[j][0] for j in members[find(k)]), n[k]) for k in n), members


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    passage = prose(rng, 60)
    for k in range(60):
        w = prose(rng, rng.choice([3, 8, 40, 120, 400]))
        if k % 3 == 0:
            w = w[:5] + passage + w[5:]
        rows.append((len(rows), " ".join(w)))
    for k in range(20):  # a cluster of near copies, and exact ones
        rows.append((len(rows), " ".join(edited(rng, rows[7][1].split(), 0.04))))
        rows.append((len(rows), rows[4 + k % 3][1]))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n\t "), (None, rows[0][1])]
    return rows


def near(docs):
    return sorted(tuple(r) for r in jaccard.near_copies(docs).collect())


def test_near_copies_equal_brute_force(spark, corpus):
    want, _ = brute_classes(corpus, brute_links(corpus))
    assert near(make(spark, corpus)) == want and len(want) > 40 and max(n for _, _, n in want) > 10


def test_pairs_equal_brute_force(spark, corpus):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.jaccard_pairs(make(spark, corpus)).collect()}
    first = {}
    for i, t in sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(t, i)
    want = {(corpus[a][0], corpus[b][0]): j for (a, b), j in brute_links(corpus).items() if first[corpus[a][1]] == corpus[a][0] and first[corpus[b][1]] == corpus[b][0]}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("block,hot", [(3, 2)])
def test_blocks_and_hot_tokens_lose_no_link(spark, corpus, monkeypatch, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_DF", hot)
    monkeypatch.setattr("lodespark.llm.common.BROADCAST_BYTES", 0)
    assert near(make(spark, corpus)) == brute_classes(corpus, brute_links(corpus))[0]


def test_documents_without_half_their_ngrams_elsewhere_stay_out_of_the_join(spark, monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 20)
    rows = [(k, " ".join(prose(rng, 30) + passage + prose(rng, 30))) for k in range(60)]
    rows += [(60, " ".join(edited(rng, rows[0][1].split(), 0.03))), (61, "a b"), (62, "A b!"), (63, "a c")]
    seen, met = [], jaccard._postings
    monkeypatch.setattr(jaccard, "_postings", lambda docs, *more: seen.append(docs.count()) or met(docs, *more))
    assert near(make(spark, rows)) == brute_classes(rows, [*brute_links(rows), (61, 62)])[0]
    assert seen == [4]


def test_near_copies_of_one_large_group(spark):
    """All rows in one group, many of them equal: links are counted, not listed."""
    rng = random.Random(3)
    base = prose(rng, 80)
    rows = [(k, " ".join(edited(rng, base, 0.02) if k % 3 else base)) for k in range(240)]
    assert near(make(spark, rows)) == brute_classes(rows, brute_links(rows))[0]


def test_a_cluster_costs_cells_in_proportion_to_its_size(spark, monkeypatch):
    """Each near copy shares its last words with one other; those two must not be a group that the whole cluster asks."""
    rng = random.Random(12)
    base, asides = prose(rng, 120), [prose(rng, 6) for _ in range(100)]
    rows = [(k, " ".join(edited(rng, base, 0.02) + asides[k // 2])) for k in range(200)]
    seen, whole = [], jaccard.in_blocks
    monkeypatch.setattr(jaccard, "in_blocks", lambda cells, block: seen.append(cells.count()) or whole(cells, block))
    assert near(make(spark, rows)) == brute_classes(rows, brute_links(rows))[0]
    assert seen[0] < 10 * len(rows)


def test_overlaps_of_rare_and_frequent_tokens():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 30, 25), rng.integers(30, 4000, 200)])).astype(np.uint64) for _ in range(90)]
    want = [[len(np.intersect1d(x, y)) for y in sets[:70]] for x in sets]
    assert jaccard._overlaps(sets, sets[:70]).tolist() == want
    assert jaccard._overlaps(sets[:2], sets[5:6]).tolist() == [[len(np.intersect1d(x, sets[5]))] for x in sets[:2]]


def test_near_copies_edge_cases(spark):
    assert near(make(spark, [])) == [] and jaccard.jaccard_pairs(make(spark, [])).count() == 0
    same = make(spark, [(1, "a b"), (1, "a b"), (2, "A, b!"), (3, "a b c"), (4, None), (5, None), (6, ""), (7, ""), (None, "a b")])
    assert near(same) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert [tuple(r) for r in jaccard.jaccard_pairs(same).collect()] == [(1, 2, 1.0)]
    clash = same.selectExpr("doc_id", "text", "1 AS bucket", "'x' AS blob", "2 AS grp", "3 AS key", "4 AS __key", "5 AS m")
    assert near(clash) == near(same)
    assert jaccard.keep_one(clash).columns == clash.columns and jaccard.keep_one(clash).count() == 7
    long = " ".join(f"x{k}" for k in range(60_000))
    assert near(make(spark, [(1, long), (2, long + " y")])) == [(1, 1, 1), (2, 1, 1)]
    ties = [(k, "p q r s") for k in (5, 3, 4)]
    assert near(make(spark, ties)) == [(3, 3, 2), (4, 3, 2), (5, 3, 2)]


def test_keep_one(spark, corpus):
    kept = jaccard.keep_one(make(spark, corpus)).collect()
    _, members = brute_classes(corpus, brute_links(corpus))
    want = [min((corpus[k] for k in g), key=lambda r: r[0]) if corpus[g[0]][0] is not None else corpus[g[0]] for g in members.values()]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def test_keep_one_judges_rows_not_ids(spark):
    a, u = "one two three four", "quite another text here"
    rows = [(1, a), (5, a), (5, u), (1, a), (None, a), (9, None), (9, None)]
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(make(spark, rows)).collect()), key=str)
    assert got == sorted([(1, a), (5, u), (None, a), (9, None), (9, None)], key=str)


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "doc_a long, doc_b long")
    got = {r.doc_id: r.root for r in jaccard.components(pairs).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == 100
    assert jaccard.components(pairs.limit(0)).count() == 0


def brute_spans(rows, least):
    places = defaultdict(list)
    docs = sorted({(i, t) for i, t in rows if i is not None and t})
    for k, (i, t) in enumerate(docs):
        w = t.split()
        for s in range(len(w) - least + 1):
            places[tuple(w[s : s + least])].append((k, s))
    every, later = defaultdict(set), defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for x, (k, s) in enumerate(sorted(at)):
                every[k].update(range(s, s + least))
                if x:
                    later[k].update(range(s, s + least))
    return docs, every, later


@pytest.fixture(scope="module")
def repeating():
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (49, 50, 51, 90, 200)]
    rows = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += prose(rng, rng.randrange(60)) + rng.choice(passages)[: rng.choice([30, 60, 500])]
        rows.append((len(rows), "  ".join(w) + "\n" * rng.randrange(2)))
    rows += [(len(rows), "la " * 300), (len(rows) + 1, " ".join(["a", "b", "c"] * 60)), (len(rows) + 2, None), (len(rows) + 3, ""), (None, "la " * 300), rows[0], rows[1]]
    return rows


def test_repeats_equal_brute_force(spark, repeating):
    docs, every, later = brute_spans(repeating, 50)
    got_all, got_later = defaultdict(set), defaultdict(int)
    for r in substring.repeats(make(spark, repeating)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        assert not got_all[r.doc_id] & set(range(r.start_word, r.end_word))
        got_all[r.doc_id] |= set(range(r.start_word, r.end_word))
        got_later[r.doc_id] += r.later_words
    assert dict(got_all) == {docs[k][0]: v for k, v in every.items()}
    assert {k: v for k, v in got_later.items() if v} == {docs[k][0]: len(v) for k, v in later.items()}


def test_cut_repeats(spark, repeating):
    docs, _, later = brute_spans(repeating, 50)
    want = {}
    for k, (i, t) in enumerate(docs):
        kept = [w for x, w in enumerate(t.split()) if x not in later[k]]
        if kept or not later[k]:
            want[i] = kept
    out = substring.cut_repeats(make(spark, repeating))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None and r.text}
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert out.filter("doc_id IS NULL OR text IS NULL OR text = ''").count() == sum(i is None or not t for i, t in repeating)
    again = substring.repeats(out.filter("doc_id IS NOT NULL"), least=60)
    assert again.filter("later_words > 0").count() == 0


def test_repeats_edge_cases(spark):
    assert substring.repeats(make(spark, [])).count() == 0
    assert substring.cut_repeats(make(spark, [])).count() == 0
    t = " ".join(f"x{k}" for k in range(80))
    two = make(spark, [(1, t), (1, t), (2, t)]).selectExpr("doc_id", "text", "1 AS ver", "2 AS pos", "'x' AS __cuts")
    rows = sorted((r.doc_id, r.n_words, r.later_words) for r in substring.repeats(two).collect())
    assert rows == [(1, 80, 0), (2, 80, 80)]
    kept = substring.cut_repeats(two)
    assert kept.columns == two.columns and [r.doc_id for r in kept.collect()] == [1, 1]
