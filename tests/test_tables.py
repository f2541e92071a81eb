"""Graphs made of tables, before they are closed."""

from __future__ import annotations

import pytest

from codeloom.sources.tables import trade
from tests.compare import duck, same

EDGES = """
select distinct c_nationkey as l, s_nationkey as r from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
where c_nationkey != s_nationkey"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trade_over_all_items(spark, sf):
    d = f"/root/testdata/{sf}"
    edges = trade(*(spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier")))
    same(edges.select("l", "r").toPandas(), duck(d, EDGES))
