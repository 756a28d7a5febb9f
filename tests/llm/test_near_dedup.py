import math
from collections import Counter

import numpy as np
import pytest

from quire.llm import near_dedup as N
from quire.llm import shingles as S

SCHEMA = "doc_id long, text string, row string, digest string, bands string, doc int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "r", None, "b", 1) for i, t in rows], SCHEMA).repartition(parts)


def bag(text):
    """Shingle -> weight."""
    return Counter({g: 1 + math.log(n) for g, n in counts(text).items()})


def counts(text):
    w = (text or "").encode().split()
    if not w:
        return Counter()
    return Counter([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)])


def jp(a, b):
    """Probability Jaccard by its definition."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in set(a) & set(b))


def brute(rows):
    """Connected components of all pairs at 0.8 or more: row number -> smallest id of its class."""
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "").split() == (rows[j][1] or "").split() or jp(bags[i], bags[j]) >= 0.8 - 1e-9:
                up[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return sorted(((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=str)


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"new{rng.integers(10 ** 6)}"
    return " ".join(words)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = rng.choice(vocab, size=rng.integers(4, 160))
        for _ in range(rng.integers(1, 8)):
            rows.append((k, edit(rng, base, int(rng.integers(0, 4)))))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one two"), (k + 4, "one two"), (k + 5, "two one"), (None, rows[0][1])]
    rows += [rows[5], rows[5], (k + 6, "same line again here now " * 40), (k + 7, "same line again here now " * 41 + "end")]
    return rows


def test_sample_similarity_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a = " ".join(rng.choice(list("abc"), size=rng.integers(1, 60)))
        b = " ".join(rng.choice(list("abc"), size=rng.integers(1, 60)))
        at, e, c = S.shingles([a.encode(), b"", b.encode()])
        x, y = at == 0, at == 2
        assert not (at == 1).any() and c[x].sum() == max(1, len(a.split()) - 4)
        w = S.weights(c)
        assert abs(S.probability_jaccard(e[x], w[x], e[y], w[y]) - jp(bag(a), bag(b))) < 1e-12


def test_signature_agreement_estimates_probability_jaccard():
    a, b = bag("a b c d e f g h i j k l m n " * 3), bag("a b c d e f g h i j k l m n " * 2 + "o p q r s t u v")
    at, e, c = S.shingles([" ".join(["a b c d e f g h i j k l m n"] * 3).encode(), ("a b c d e f g h i j k l m n " * 2 + "o p q r s t u v").encode()])
    c = S.weights(c)
    sig = N.prob_minhash(at, e, c, 2, 20_000)
    assert abs((sig[0] == sig[1]).mean() - jp(a, b)) < 0.015
    alone = [N.prob_minhash(np.zeros((at == k).sum(), dtype=int), e[at == k], c[at == k], 1, 64)[0] for k in (0, 1)]
    both = N.prob_minhash(at, e, c, 2, 64)
    assert (both[0] == alone[0]).all() and (both[1] == alone[1]).all()  # a text's signature doesn't depend on its neighbours


@pytest.mark.parametrize("seed", [1])
def test_classes_match_brute_force(spark, seed):
    rows = corpus(seed)
    sigs = N.signatures(frame(spark, rows))
    got = N.near_classes(sigs).collect()
    assert sorted(((r.id, r.class_id, r.class_size) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r.class_id, r.class_size) for r in got if r.class_id is not None}) and all(r.id == r.class_id for r in kept)
    left = N.drop_near_copies(frame(spark, rows))
    assert left.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.id for r in kept)


def test_large_group_of_different_copies(spark, monkeypatch):
    """Copies edited from one text: some pairs are below 0.8, so one pivot isn't enough; blocks of eight rows."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(7)
    base = rng.choice([f"w{i}" for i in range(300)], size=90)
    rows = [(i, edit(rng, base, int(rng.integers(0, 3)))) for i in range(90)]
    rows += [(1000 + i, edit(rng, base, 5)) for i in range(25)]
    got = sorted(((r.id, r.class_id, r.class_size) for r in N.near_classes(N.signatures(frame(spark, rows))).collect()), key=str)
    assert got == brute(rows)


def test_block_comparison_finds_all_pairs(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 7)
    rng = np.random.default_rng(11)
    base = rng.choice([f"w{i}" for i in range(60)], size=70)
    texts = [edit(rng, base, int(rng.integers(0, 5))) + (" again and again and again and again and" * (i % 3 == 0)) for i in range(40)]
    label, bands = np.arange(40) // 2, np.full((40, 2), 5)
    left, right = np.arange(0, 40, 3), np.arange(40)
    x, y = N.linked_pairs([t.encode() for t in texts], bands, label, left, right, 5, 0.8)
    want = {(i, j) for i in left for j in right if label[i] != label[j] and jp(bag(texts[i]), bag(texts[j])) >= 0.8 - 1e-9}
    assert set(zip(x, y)) == want and 20 < len(want) < len(left) * len(right)
    assert not len(N.linked_pairs([t.encode() for t in texts], bands, label, left, right, 6, 0.8)[0])


def test_empty_table(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert N.near_classes(N.signatures(empty)).collect() == []
    assert N.drop_near_copies(empty).collect() == []


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    texts = [b"", b" a  bc\t", b"x" * 700, b"\n" + b"y" * 300 + b" end", (b"some words of a text \x0b" * 40), b"zz", b" " * 200, b"q" * 64 + b" " + b"q" * 63]
    want = S.word_hashes(texts)
    assert [int(n) for n in np.bincount(want[0], minlength=len(texts))] == [len(t.split()) for t in texts]
    for window in (64, 65, 100):
        monkeypatch.setattr(S, "WINDOW", window)
        got = S.word_hashes(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    long = rng.choice([f"w{i}" for i in range(50_000)], size=400_000)
    rows = [(1, " ".join(long)), (2, edit(rng, long, 1000)), (3, "z" * 3_000_000), (4, "z" * 3_000_000 + "y"), (5, "z" * 3_000_000)]
    got = sorted((r.id, r.class_id, r.class_size, r.kept) for r in N.near_classes(N.signatures(frame(spark, rows))).collect())
    assert got == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 3, 2, False)]


def test_stretches_of_shingles_change_no_signature(monkeypatch):
    texts = [" ".join(f"t{(i * k) % 91}" for i in range(30 + 40 * k)).encode() for k in range(9)]
    at, e, c = S.shingles(texts)
    want = N.prob_minhash(at, e, S.weights(c), 9, 48)
    for n in (1, 7, 100):
        monkeypatch.setattr(N, "STRETCH", n)
        assert (N.prob_minhash(at, e, S.weights(c), 9, 48) == want).all()


def test_units_meet_other_classes_only(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    rows = [(1, i, 500 if i < 40 else i, 10) for i in range(50)] + [(2, i, i % 3, 10) for i in range(6)] + [(3, i, i // 20, 10) for i in range(40)]
    got = N.with_blocks(spark.createDataFrame(rows, "bucket long, row long, label long, size long")).collect()
    met = {}
    for r in got:
        for m in r.meets:
            met.setdefault((r.bucket, min(r.block, m), max(r.block, m)), []).append(r)
    for bucket, n in ((1, 50), (2, 6), (3, 40)):
        mine = [r for r in got if r.bucket == bucket]
        assert len(mine) == n
        pairs = {(a.row, b.row) for a in mine for b in mine if a.label < b.label}
        found = {(a.row, b.row) for (k, _, _), rs in met.items() if k == bucket for a in rs for b in rs if a.label < b.label}
        assert found == pairs
    # The class of 40 has five blocks, which never meet each other or themselves.
    big = {r.block for r in got if r.bucket == 1 and r.label == 500}
    assert len(big) == 5 and not any(k == 1 and i in big and j in big for k, i, j in met)
