import math
import random

import numpy as np
import pytest

from quire.llm import bit_sliced as B

SCHEMA = "vec_id long, embedding array<float>, id string, row long, tile int, slices string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 7, 1, "y") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k=10, every=100):
    whole = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows
             if v and all(c is not None and math.isfinite(c) and abs(c) < 2 ** 43 for c in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(whole) if b != a))
        out += [(i, r + 1, None if unknown else j, max(min(-s, 2 ** 63 - 1), -2 ** 63)) for r, (s, unknown, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(n, d, seed, spread=1.0):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0, spread) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "wide values", "copies", "narrow", "ragged", "huge"])
def test_equals_brute_force(spark, case):
    rows = {"plain": some(700, 16, 1), "wide values": some(300, 8, 2, 5000.0), "copies": some(200, 8, 3) + [(1000 + i, [0.5] * 8) for i in range(300)],
            "narrow": [(i, [0.001 * (i % 3)]) for i in range(250)], "ragged": [(i, v[: 1 + i % 6]) for i, v in some(300, 6, 4)],
            "huge": some(120, 4, 5) + [(500 + i, [3e12 + i * 1e9, -8e12, 1.0, 0.25]) for i in range(5)]}[case]
    assert got(B.top_k(B.bit_sliced_index(frame(spark, rows)))) == brute(rows)


def test_units_of_tiles_and_groups(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "TILE_QUERIES", 7)
    rows = some(900, 8, 6)
    index = B.bit_sliced_index(frame(spark, rows), every=20)
    assert index.count() >= 14
    assert got(B.top_k(index, every=20)) == brute(rows, every=20)


def test_edges(spark):
    rows = [(0, None), (100, []), (200, [None, 1.0]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, [0.0, 0.0]),
            (600, [1.0, -1.0]), (600, [1.0, -1.0]), (None, [2.0, 2.0]), (None, [2.0, 2.0]), (7, [-0.0001, 0.0])]
    out = got(B.top_k(B.bit_sliced_index(frame(spark, rows))))
    assert out == brute(rows)
    assert sum(r[0] == 600 for r in out) == 2 * 5  # a repeated row is a query of its own, and the other's candidate
    assert got(B.top_k(B.bit_sliced_index(frame(spark, [])))) == []
    assert got(B.top_k(B.bit_sliced_index(frame(spark, [(100, [1.0])])))) == []


def test_slices_hold_the_upper_bits():
    x = np.array([[-540.0, 3.0], [539.0, -1.0], [0.0, 8.0]])
    shift, slices = B.bit_slices(x)
    value = sum((np.unpackbits(slices[:, s].copy().view(np.uint8), axis=1, bitorder="little")[:, :3].astype(int) << s) for s in range(B.SLICES))
    assert shift == 3 and (value.T - 128 == np.floor(x / 8)).all()


def test_sums_and_selection():
    rnd = np.random.default_rng(8)
    x, q = rnd.integers(-100, 100, (130, 5)).astype(float), rnd.integers(-1000, 1000, 5).astype(float)
    shift, slices = B.bit_slices(x)
    query = B.Query(q)
    sums = query.sums(slices, ~slices)
    bits = [np.unpackbits(b.view(np.uint8), bitorder="little")[:130].astype(object) for b in sums]
    total = sum(b * (1 << i) for i, b in enumerate(bits)) - query.constant
    assert shift == 0 and total.tolist() == (x @ q).astype(int).tolist()
    live = np.packbits(np.arange(192) < 130, bitorder="little").view(np.uint64)
    ordered = sorted(total.tolist(), reverse=True)
    assert [B.kth_largest(sums, live, k) - query.constant for k in (1, 10, 130)] == [ordered[k - 1] for k in (1, 10, 130)]
    assert B.kth_largest(sums, live, 131) is None


def test_query_equals_brute_force_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    assert got(B.q_vector_search(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in table])
