import glob
from collections import Counter

import duckdb
import pytest

from wordtide.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    q = duck.execute(ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(q.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 111
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
