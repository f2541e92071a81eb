"""Every registered engine query against its expected rows."""

from __future__ import annotations

import pytest

import codeloom.queries as q
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, name):
    same(q.QUERIES[name](spark, SF).toPandas(), duck(SF, q.SQL[name]))
    spark.catalog.clearCache()
