import os

import duckdb
import pytest

from findmill.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return made


def rows(df):
    columns = sorted(df.columns)
    clean = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return sorted(str([int(x) if isinstance(x, float) and x == int(x) else x for x in r]) for r in clean)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(views.sql(ORACLE_SQL[name]).df())
    else:
        assert len(found)
