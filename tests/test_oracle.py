"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from lorequarry import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    found, wanted = rows(got.columns, [tuple(r) for r in got.collect()]), rows(rel.columns, rel.fetchall())
    assert len(found) == len(wanted) and found == wanted
