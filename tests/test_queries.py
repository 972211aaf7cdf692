import pytest

from loomset.queries import QUERIES, SQL
from tests.conftest import SF_SMALL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in SQL:
        assert df.count() > 0
        return
    same, note = compare(df, con, SQL[name])
    assert same, note
