import pytest

from kelpline.llm import queries
from tests.oracle import connect, same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])
