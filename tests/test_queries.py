import math

import duckdb
import pytest
from conftest import SF
from lexgrain.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
