"""Every registered query of the engine against DuckDB at the smallest scale."""

import duckdb
import pytest

from latticeforge.plans.oracles import oracles
from latticeforge.plans.queries import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def table(frame):
    columns = sorted(frame.columns)
    rows = [tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, duck, name):
    assert table(queries()[name](spark, DATA).toPandas()) == table(duck.sql(oracles()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracles())))
def test_other_queries_run(spark, name):
    assert queries()[name](spark, DATA).count() > 0
