import numpy as np
import pytest

from linewell.llm import embedding_whitening as ew
from linewell.llm.common import session

SCHEMA = "vec_id long, embedding array<float>, label int, component int, v map<string,string>"


def frame(spark, rows):
    return session(spark).createDataFrame([(*r, 1, 5, {"a": "b"}) for r in rows], SCHEMA)


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(1, 0.1, d)
    return (rng.normal(size=(n, d)) @ mix * 0.2).astype(np.float32)


@pytest.mark.parametrize("d,rank", [(1, 1), (7, 7), (40, 40), (33, 5), (12, 0)])
def test_cholesky_and_rotations_equal_the_eigen_decomposition(d, rank):
    x = np.random.default_rng(d).normal(size=(200, rank)) @ np.random.default_rng(2).normal(size=(rank, d))
    a = x.T @ x
    l, order = ew.pivoted_cholesky(a)
    assert l.shape[1] == rank and np.allclose(l @ l.T, a[np.ix_(order, order)]) and np.allclose(l, np.tril(l))
    values, u = ew.principal(a)
    assert len(values) == rank and np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-10)
    assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12) and np.allclose(a @ u, u * values, atol=1e-9 * max(values.max(initial=1.0), 1))


def test_query_rows_equal_numpy(spark):
    v = vectors(300, 40)
    got = sorted(map(tuple, ew.whitening(frame(spark, [(k, row.tolist()) for k, row in enumerate(v)])).collect()))
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    s, n = x.sum(0), len(x)
    cov = (x - x.mean(0)).T @ (x - x.mean(0)) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want = (x - s / n) @ u / np.sqrt(e)
    w = np.array([r[4] for r in got]).reshape(n, 32)
    sign = np.sign((w * want).sum(0))
    assert [r[:2] for r in got] == [(k, c) for k in range(n) for c in range(1, 33)] and {r[2] for r in got} == {n}
    assert [r[3] for r in got[::32]] == [int(((n * row - s) ** 2).sum()) for row in x]
    assert np.allclose(w, want * sign, atol=1e-8) and np.allclose([r[5] for r in got[:32]], e / np.trace(cov), rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and got[0][6] < 1e-10


def test_rows_without_a_sound_vector_are_left_out(spark):
    v = vectors(30, 4)
    rows = [(k, row.tolist()) for k, row in enumerate(v)]
    odd = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [float("nan"), 1.0, 1.0, 1.0]), (93, [float("inf"), 1.0, 1.0, 1.0]), (94, []), (95, [1.0, 2.0]), (None, rows[0][1]), (3, rows[3][1])]
    got = ew.whitening(frame(spark, rows + odd)).collect()
    assert {r["n"] for r in got} == {32} and sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == list(range(30))
    assert len(got) == 32 * 4 and sum(r["vec_id"] is None for r in got) == 4 and len({r["whitened"] for r in got if r["vec_id"] in (3,)}) == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 5])
def test_tables_without_variance_give_no_rows(spark, rows):
    assert ew.whitening(frame(spark, rows)).collect() == []


def test_lower_rank_and_very_large_entries(spark):
    flat = [(k, [float(k % 5), float(2 * (k % 5)), 1.0]) for k in range(50)]
    got = ew.whitening(frame(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-10
    wide = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])]
    assert {r["deviation"] for r in ew.whitening(frame(spark, wide)).collect()} == {None, 128 ** 2}
    big = ew.Whitening(2, 3, [5, -7], np.array([5 / 3, -7 / 3]), np.ones(1), np.ones((2, 1)), 1.0, 0.0)
    y = np.array([[1e8, -1e8], [2.0 ** 40, 0.0]])
    assert big.deviations(y) == [(3 * 10 ** 8 - 5) ** 2 + (-3 * 10 ** 8 + 7) ** 2, None]


def test_exact_sums_of_wide_entries(spark):
    rows = [(k, [2.0 ** 45 + 2.0 ** 22 * k, -1.0]) for k in range(100)]
    found = {(r["d"], r["i"]): (r["n"], int(r["s"])) for r in ew.sums(frame(spark, rows).select("embedding"))}
    assert found == {(2, -1): (100, 0), (2, 0): (100, sum(int(64 * np.float32(r[1][0])) for r in rows)), (2, 1): (100, -6400)}
