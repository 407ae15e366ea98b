import duckdb
import pytest

from oreline.plans import cases, evidence  # noqa: F401
from oreline.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr), sorted(columns)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert got == rows(cursor.fetchall(), [c[0] for c in cursor.description])
