import pytest

from tests.compare import connect, oracle_rows, spark_rows
from tests.conftest import SMALLEST
from workload.oracle import ORACLE
from workload.queries import REGISTERED

# They share long chains of steps with search_paged and summary, which run always.
SLOW = set(
    "bm25 best_fields keyword_scores hybrid ranked_page totals search highlights snippets present "
    "context pool sentence_rank".split()
)
QUICK = [name for name in ORACLE if name not in SLOW]


@pytest.fixture(scope="module")
def con():
    return connect(SMALLEST)


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, con, name):
    assert spark_rows(REGISTERED[name](spark, SMALLEST)) == oracle_rows(con, ORACLE[name])


@pytest.mark.slow
@pytest.mark.parametrize("name", sorted(SLOW))
def test_matches_sql_slow(spark, con, name):
    assert spark_rows(REGISTERED[name](spark, SMALLEST)) == oracle_rows(con, ORACLE[name])


def test_every_query_but_approximate_and_learned_ones_has_sql():
    assert set(REGISTERED) - set(ORACLE) == {"ann", "learned_neighbours"}
