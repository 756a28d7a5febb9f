import functools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import packing as P

SCHEMA = "doc_id long, text string, start string, length string, ids string, sequence_id string"


def docs(spark, rows, parts=2):
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in rows], SCHEMA).repartition(parts)


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


@functools.cache
def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces, window=2048):
    """Pieces cover each document's ids once, sequences are gapless and short of the window only at powers of two."""
    want = sorted((str(i), tuple(ids_of(t))) for i, t in rows)
    by_doc, by_seq = {}, {}
    for p in pieces:
        got = np.frombuffer(p.ids, "<u4")
        assert len(got) == p.length > 0
        by_doc.setdefault((str(p.id), p.doc_tokens), []).append((p.start, tuple(got)))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    got = []
    for (i, n), parts in by_doc.items():
        parts.sort()
        flat = [x for _, ids in parts for x in ids]
        for k in range(len(flat) // n):  # repeated rows share an id
            got.append((i, tuple(flat[k * n:(k + 1) * n])) if len(flat) == n else (i, None))
    if all(x is not None for _, x in got):
        assert sorted(got) == want
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        assert at == window or at & (at - 1) == 0
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)


def test_pack_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (None, "no id"), (2 ** 60 + 1, "big id"), (7, "word " * 30_000), (8, " \n  x\t y   z "),
            (9, "<|endoftext|> 's don't"), *[(100 + i, "Zwölf große Wörter. " * (i * 7 % 90)) for i in range(120)]]
    check(rows, P.pack(docs(spark, rows)).collect())


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "the same row here")] * 40
    out = P.pack(docs(spark, rows)).collect()
    assert sum(p.length for p in out) == 40 * len(ids_of("the same row here"))
    assert P.pack(docs(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("window,max_open", [(8, 3), (64, 5), (64, 1000)])
def test_small_windows(spark, window, max_open):
    rng = np.random.default_rng(window)
    rows = [(i, " ".join(rng.choice(["of", "the", "reading", "été"], size=rng.integers(0, 60)))) for i in range(200)]
    check(rows, P.pack(docs(spark, rows), window=window, max_open=max_open).collect(), window)


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = P.Packer(32, 10 ** 9, 0)
    for _ in range(600):
        size = int(rng.integers(1, 32))
        before = packer.count.copy()

        def squares(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 32:
                c[h + size] += 1
            return int((c ** 2).sum())

        options = [h for h in range(0, 32 - size + 1) if h == 0 or before[h]]
        packer.place(None, 0, b"\0\0\0\0" * size)
        assert int((packer.count ** 2).sum()) == min(map(squares, options))
        assert packer.count[0] == packer.count[32] == 0


def test_words_encode_as_the_file_does():
    enc = P.WordEncoder(P.default_tokenizer(), cache_words=40)
    rng = np.random.default_rng(1)
    odd = ["a  b", " a", "a ", "  ", "", "a \nb", "a\n \nb", "it's we've", "<|endoftext|> x", "　 a\x85 b", "naïve, café. ſtraße ǅ"]
    odd += ["".join(rng.choice(list("ab 'é1.,\n\t    "), size=rng.integers(0, 30))) for _ in range(800)]
    for _ in range(2):
        assert enc.batch(odd) == [np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = P.q_packing(spark, sf).collect()
    texts = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {i: 0 for i in texts}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        ids = texts[p.doc_id][p.start:p.start + p.length]
        assert p.start == seen[p.doc_id] and p.doc_tokens == len(texts[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        seen[p.doc_id] += p.length
    assert all(seen[i] == len(x) for i, x in texts.items())
    fills = {}
    for p in got:
        fills[p.sequence_id] = fills.get(p.sequence_id, 0) + p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())
    assert spark.createDataFrame(got).select(F.countDistinct("sequence_id", "offset")).first()[0] == len(got)


@pytest.mark.parametrize("n", [1000, 1600, 8000])
def test_placements_stand(n):
    """Of the remainders of a task's documents nine tenths stay where the rule placed them."""
    rng = np.random.default_rng(n)
    packer = P.Packer(2048, 4096, 0)
    sizes = np.minimum(2047, rng.lognormal(6.2, 0.8, n).astype(int) + 1)
    out = [e for i, size in enumerate(sizes) for e in packer.place(i, 0, bytes(4 * int(size)))] + packer.drain(last=True)
    whole = {doc for _, _, (doc, _, _, stays) in out if stays}
    assert len(whole) >= 0.9 * n and not any(doc in whole for _, _, (doc, _, _, stays) in out if not stays)
    tokens, fills = {}, {}
    for seq, at, (doc, start, ids, _) in sorted(out, key=lambda e: (e[0], e[1])):
        assert at == fills.get(seq, 0)
        fills[seq] = at + len(ids) // 4
        tokens[doc] = tokens.get(doc, 0) + len(ids) // 4
    assert [tokens[i] for i in range(n)] == sizes.tolist()
    short = [f for f in fills.values() if f < 2048]
    assert all(f & (f - 1) == 0 for f in short) and sum(short) < 2048


def test_closing_before_the_end_leaves_one_window_open():
    packer = P.Packer(16, 4, 0)
    out = [e for i in range(60) for e in packer.place(i, 0, bytes(4 * (9 + i % 5)))]
    assert packer.open <= 4 and out
    fills = {}
    for seq, _, p in out:
        fills[seq] = fills.get(seq, 0) + len(p[2]) // 4
    assert set(fills.values()) == {16}
