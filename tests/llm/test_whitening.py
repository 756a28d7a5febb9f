import numpy as np
import pytest

from quire.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, id string, vec int, n int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 7, 1) for i, v in rows], SCHEMA).repartition(parts)


def check(rows, out, k=8, tolerance=1e-9):
    """``rows``: those that take part."""
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, total)) for r in x]
    by_id = {}
    for r in out:
        by_id.setdefault(r["id"], {})[r["component"]] = r
    for p, (i, _) in enumerate(rows):
        mine = by_id[i]
        assert sorted(mine) == list(range(1, k + 1))
        for c, r in mine.items():
            assert r["n"] == n and r["deviation"] == deviation[p]
            assert abs(abs(r["whitened"]) - abs(centred[p] @ u[:, c - 1]) / np.sqrt(e[c - 1])) < tolerance
            assert abs(r["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert len(out) == len(rows) * k


def test_equals_eigenvectors(spark):
    rnd = np.random.default_rng(1)
    mixed = rnd.normal(size=(300, 12)) @ rnd.normal(size=(12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    check(rows, W.whitened(frame(spark, rows)).collect())


def test_small_eigenvalues_keep_their_accuracy(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(400, 5)) * [400, 30, 20, 2, 0.1])]
    check(rows, W.whitened(frame(spark, rows)).collect(), k=5, tolerance=1e-7)


def test_rows_that_take_no_part(spark):
    rnd = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(50, 3)))]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0, float("-inf"), 1.0]),
           (105, [1e300, 0.0, 0.0]), (106, [1.0, 2.0]), (107, [1.0] * 9)]
    check(good, W.whitened(frame(spark, good + bad)).collect(), k=3)


def test_repeated_rows_and_null_identifiers(spark):
    rnd = np.random.default_rng(4)
    base = [(None if i % 7 == 0 else i, v.tolist()) for i, v in enumerate(rnd.normal(size=(40, 2)))]
    out = W.whitened(frame(spark, base + base)).collect()
    assert len(out) == 160 and {r["n"] for r in out} == {80} and sum(r["id"] is None for r in out) == 24


def test_rank_ends_the_components(spark):
    rnd = np.random.default_rng(5)
    two = rnd.integers(-5, 5, size=(60, 2))
    rows = [(i, [float(a), float(b), float(a + b), 1.0]) for i, (a, b) in enumerate(two.tolist())]
    out = W.whitened(frame(spark, rows)).collect()
    assert {r["component"] for r in out} == {1, 2} and all(r["identity_error"] < 1e-9 for r in out)
    for rows in ([], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(30)], [(1, None)]):
        out = W.whitened(frame(spark, rows))
        assert out.collect() == [] and out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact():
    x = np.array([[2 ** 50, -3], [5, 2 ** 51 + 1]])
    sums = [int(v) for v in x.sum(axis=0)]
    assert W.deviations(x, 2, sums) == [None, None]
    x = np.array([[2 ** 29 + 1, -3], [5, 7]])
    sums = [int(v) for v in x.sum(axis=0)]
    assert W.deviations(x, 2, sums) == [sum((2 * int(a) - b) ** 2 for a, b in zip(r, sums)) for r in x]


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_factor_and_rotations(size):
    rnd = np.random.default_rng(size)
    a = rnd.normal(size=(size + 5, size))
    a = a.T @ a
    factor = W.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a)
    g = W.one_sided_jacobi(factor)
    assert np.allclose(g @ g.T, a) and np.allclose((g * g).sum(axis=0), np.linalg.eigvalsh(a)[::-1])
    off = g.T @ g
    assert np.abs(off - np.diag(np.diag(off))).max() < 1e-10 * np.trace(a)


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = W.q_whitening(spark, "/root/testdata/sf0.001")
    assert out.columns[0] == "vec_id"
    check(rows, out.withColumnRenamed("vec_id", "id").collect())
