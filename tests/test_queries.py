"""Every registered query of the core library against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

from stackmill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_duckdb(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert got
        return
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    pick = lambda rows, have: sorted(repr([plain(r[have.index(c)]) for c in columns]) for r in rows)
    assert pick(got, df.columns) == pick(want.fetchall(), list(want.columns))


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert all(re.fullmatch(r"[a-lx]\d+_[a-z0-9_]+", n) for n in registry.queries())
    assert registry.FLAGSHIP in registry.queries()
