"""Each registered query of the library against its SQL, or for rows only."""

from __future__ import annotations

import pytest
from oracle import same

from millrace.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, SQL[name], sf_dir)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score"]
    assert df.count() == 10
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
