import math
import re
from collections import Counter

import numpy as np

from quire.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, id string, n int, part int, row int"
ITEMS = "item_id long, text string, row string, item int"


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 7, 1, 2) for i, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, t, "x", 7) for i, t in items], ITEMS).repartition(2))


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if unknown else i, -s) for r, (s, unknown, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k=20):
    return sorted((tuple(r) for r in L.search(*frames(spark, docs, items), k=k).collect()), key=str)


def corpus(n=260):
    words = ["alpha", "Beta", "gamma7", "déjà", "naïve", "漢字", "x", "the", "of", "ÀB"]
    docs = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(1 + i % 23)) + ("." if i % 2 else "-The")) for i in range(n)]
    docs += [(None, "alpha beta"), (None, "alpha beta"), (5, docs[5][1]), (5, docs[5][1]), (900, ""), (901, None), (902, "?! -- \x7f"),
             (903, "unique"), (904, "the " * 5000 + "alpha")]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    items = [(1, "alpha the THE beta"), (2, "Déjà vu NAÏVE"), (3, None), (4, ""), (5, "nothing here"), (6, "unique unique unique"), (1, "漢字 àb Àb x"),
             (None, "gamma7"), (7, "the of " * 300)]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_stretches_cut_no_term():
    text = "  ab, cd-éf " * 50 + "x" * 300
    for size in (1, 7, 100, 10_000):
        assert [t.decode() for part in L.stretches(text.encode(), size) for t in part] == terms(text)


def test_tiles_and_parts(spark, monkeypatch):
    docs, items = corpus(), [(i, f"alpha beta the of x {'déjà ' * (i % 4)} gamma{i}") for i in range(30)]
    want = brute(docs, items)
    for name, value in (("TILE_TERMS", 2), ("TILE_ITEMS", 4), ("TILE_DOCS", 17), ("PART_BYTES", 300)):
        monkeypatch.setattr(L, name, value)
    assert got(spark, docs, items) == want


def test_empty_tables(spark):
    docs, items = corpus(8), [(1, "alpha")]
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None), (2, "--")], items) == []
    assert got(spark, [(1, "beta")], items) == []


def test_long_terms_and_long_texts(spark):
    long_term = "z" * 3_000_000
    docs = [(1, long_term + " alpha"), (2, "alpha " * 400_000), (3, "beta")]
    items = [(1, "alpha " + long_term.upper())]
    assert got(spark, docs, items) == brute(docs, items)


def test_products_stay_exact():
    rnd = np.random.default_rng(1)
    left = rnd.integers(0, 3_000_000, (5, 64)).astype(float)
    right = rnd.integers(0, 14_000_000_000, (64, 7)).astype(float)
    want = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in right.T] for r in left]
    assert max(map(max, want)) > 1 << 53 and L.exact_product(left, right).tolist() == want


def test_ties_at_the_kth_score():
    best = L.Ranking(1, 3)
    ids = np.array([9, 4, 7, 2, 5, 1])
    best.add(0, np.array([[5, 5, 5, 5, 9, 0]]), ids, np.ones(6, bool))
    best.add(0, np.array([[5, 4, 0, 0, 0, 0]]), np.array([3, 8, 10, 11, 12, 13]), np.ones(6, bool))
    assert best.score[0].tolist() == [9, 5, 5] and best.id[0].tolist() == [5, 2, 3]
