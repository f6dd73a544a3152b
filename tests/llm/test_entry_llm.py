"""The subpackage's registered queries: names, contracts, oracles in DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_one_query_per_operator_and_the_pipeline():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & {n for n in E.queries() if re.match(r"op\d+_|pipeline", n)}))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = E.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)
