"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from corvane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Not SQL: their own tests are below or in test_operators.
OPEN = {"smp4_matched_controls", "ev16_density_clusters", "met23_linear_probe", "inf16_linear_regression", "inf9_module_null"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.5g}".replace("-0", "0") if float(v) == 0 else f"{float(v):.5g}"
    return str(v)


def test_every_query_has_an_oracle_or_a_test_of_its_own():
    assert set(registry.queries()) - set(registry.oracle_sql()) == OPEN


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
