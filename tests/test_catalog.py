"""Every query with an oracle is compared with DuckDB on the smallest tables; the rest must run."""
import pytest

from linewell import catalog
from tests.oracle_check import compare, duck

Q, O = catalog.queries(), catalog.oracles()
SLOW = {"ablation", "reprice"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q)


@pytest.mark.parametrize("name", sorted(O))
def test_oracle(spark, con, sf, name):
    got, want, _ = compare(spark, con, name, Q[name], O[name], sf)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q) - set(O) - SLOW))
def test_runs(spark, sf, name):
    Q[name](spark, sf).collect()


def test_streamed_ratings_equal_batch_ratings(spark, sf):
    cols = ["game_id", "f_mrtg", "f_epa", "f_pass", "f_qb", "t_pts"]
    a = sorted(map(tuple, Q["stream_ratings"](spark, sf).select(*cols).collect()))
    b = sorted(map(tuple, Q["coupled_ratings"](spark, sf).select(*cols).collect()))
    assert a == b
