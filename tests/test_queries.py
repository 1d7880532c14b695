"""Every query gives rows, and those of its SQL where it has one."""

import oracle
import pytest

from leafmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    names, rows = oracle.by_spark(catalog.QUERIES[name](spark, sf))
    assert rows or name in ("batch_gaps",)
    if name in catalog.ORACLE_SQL:
        assert (names, rows) == oracle.by_sql(catalog.ORACLE_SQL[name], sf)


def test_filters_neither_keep_nor_drop_all(spark, sf):
    counts = catalog.QUERIES["filter_metrics"](spark, sf).agg({"total_elements": "sum", "filtered_elements": "sum"}).first()
    assert 0 < counts["sum(filtered_elements)"] < counts["sum(total_elements)"]
