import functools
import math

import numpy as np
import pytest

from quire.llm import token_counts as T

SCHEMA = "doc_id long, text string, id string, n_tokens string"


@functools.cache
def vocabulary():
    return T.zipf_vocabulary(T.default_model())


def library(vocab, byte_fallback=True):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    t = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = Metaspace(replacement=T.META, prepend_scheme="always", split=True)
    return t


@functools.cache
def reference():
    return library(vocabulary())


def n(text):
    return len(reference().encode(text or "", add_special_tokens=False).ids)


def texts(seed=0):
    rng = np.random.default_rng(seed)
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb c", "▁x ▁▁y", "日本語 テキスト", "\U0001f600\U0001f601 x", "<s> <unk> <0x41>", "\x00\x01",
           "ééé", "über große Straße", "x" * 3000, "qqqqzzzz" * 200]
    out += ["".join(rng.choice(list("ab etno▁ \né日\U0001f600"), size=rng.integers(1, 40))) for _ in range(1500)]
    return out


def test_counts_equal_the_library():
    counter = T.ViterbiCounter(vocabulary(), cache_words=200)
    assert [counter.text(t)[0] for t in texts()] == [n(t) for t in texts()]
    assert [counter.text(t)[0] for t in texts()] == [n(t) for t in texts()]  # from a warm, rotating cache


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_ties_and_unknown_runs(byte_fallback):
    """Equal scores everywhere: only the tie rules decide."""
    vocab = [(T.UNKNOWN, -1.0), *((p, -1.0) for p in [T.META, "a", "b", "ab", "ba", "aa", "aab", "abb", T.META + "a"])]
    vocab += [("bb", -2.0), ("aba", -3.0), ("c", -4.0)] + ([(f"<0x{b:02X}>", -9.0) for b in range(256)] if byte_fallback else [])
    counter, lib = T.ViterbiCounter(vocab), library(vocab, byte_fallback)
    rng = np.random.default_rng(2)
    for _ in range(3000):
        t = "".join(rng.choice(list("aabbc é日 "), size=rng.integers(1, 14)))
        assert counter.text(t)[0] == len(lib.encode(t, add_special_tokens=False).ids), t


def test_score_is_the_best_by_brute_force():
    vocab = [(T.UNKNOWN, -8.0), (T.META, -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.5), ("ba", -4.0), ("aba", -5.5)]
    score = dict(vocab)
    counter = T.ViterbiCounter(vocab)

    @functools.cache
    def best(w):
        if not w:
            return 0.0
        return max(best(w[len(p):]) + s for p, s in score.items() if w.startswith(p))

    for k in range(1, 200):
        w = T.META + "".join("ab"[int(c)] for c in bin(k)[2:])
        assert math.isclose(counter.word(w)[1], best(w))


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: n(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = T.q_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "n_words", "log_prob"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want


def test_frames(spark):
    rows = [(1, None, "x", "y"), (None, "ab c", None, None), (3, "", "", ""), (3, "ab c", "", ""), (3, "ab c", "", ""), (4, "word " * 50_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.id, r.n_tokens) for r in T.token_counts(df).collect()), key=str)
    assert got == sorted(((r[0], n(r[1])) for r in rows), key=str)
    assert T.token_counts(df.where("false")).collect() == []


def test_long_words_hold_a_bounded_state(monkeypatch):
    words = [T.META + "".join(np.random.default_rng(i).choice(list("abetno漢"), size=300)) for i in range(5)] + [T.META + "ab" * 2000, T.META]
    counter = T.ViterbiCounter(vocabulary())
    want = [counter.word(w) for w in words]
    monkeypatch.setattr(T, "SPAN", 1)  # then twice the longest piece
    assert 2 * counter.longest < 300 and [counter.word(w) for w in words] == want
