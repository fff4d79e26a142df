import pytest

from latticeworks.llm import oracles, queries

from ..conftest import DATA
from ..parity import compare, connect

COLUMNS = {"p1_found": "icsd_id_a icsd_id_b", "p2_found": "community pct", "p3_found": "icsd_id_a icsd_id_b", "p4_found": "community rk icsd_id", "p5_found": "id_a id_b", "p6_ids": "doc_id ids", "p7_found": "doc_id item_id", "p8_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, connect(DATA), queries.queries()[name], oracles.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    assert df.count() > 0
