import pytest
from oracle import compare

import __spark_entry__
from siltworks.plans import catalog as queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.leaking <= r.copied <= r.documents for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sequential_queries(spark):
    for name in ("nested_subsets", "grouped_split"):
        first, again = (sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) for _ in range(2))
        assert first and first == again
    some = {}
    for r in queries.QUERIES["nested_subsets"](spark, SF).collect():
        some.setdefault(r.fraction, set()).add(r.source)
    assert some[0.25] <= some[0.5] <= some[1.0]
