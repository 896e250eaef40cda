"""Every query of the library proper against its SQL."""

import pytest
from compare import connect, same

from homerank import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    assert same(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
