"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from helpers import DATA, same_rows
from shelfmark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        same_rows(frame, duck.sql(ORACLE_SQL[name]))
    else:
        assert frame.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
