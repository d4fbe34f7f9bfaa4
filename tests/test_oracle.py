"""The core's queries against their SQL, over whole tables."""

import pytest

from markloom.plans.registry import QUERIES, SQL
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    same_rows(spark, sf, QUERIES[name], SQL[name])
