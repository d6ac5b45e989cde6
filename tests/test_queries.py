import os

import pytest
from oracle import compare

from sparkpact import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_its_sql(spark, name):
    compare(spark, name, Q.QUERIES[name], Q.ORACLE_SQL[name], SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["op", "key", "changed", "findings"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
