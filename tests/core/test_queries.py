"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return out


def ordered(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_rows_equal_the_oracles(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = con.execute(catalog.oracles()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert ordered(map(tuple, got.select(*columns).collect())) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_queries_without_sql_have_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
