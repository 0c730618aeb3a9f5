"""Every registered query of the library, on the smallest tables, against its SQL: columns, rows and values."""

import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    """Numbers as floats, everything else as text, so that rows of two engines can be sorted and compared."""
    if x is None:
        return (0, 0.0, "")
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return (1, 0.0 if math.isnan(x) else float(x), "nan" if math.isnan(x) else "")
    return (2, 0.0, str(x))


def same(a, b):
    return a[0] == b[0] and a[2] == b[2] and math.isclose(a[1], b[1], rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in registry.SQL:
        return
    want = con.sql(registry.SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    got = sorted([plain(r[c]) for c in columns] for r in rows)
    at = [want.columns.index(c) for c in columns]
    expected = sorted([plain(r[i]) for i in at] for r in want.fetchall())
    assert len(got) == len(expected)
    wrong = [(g, e) for g, e in zip(got, expected) if not all(map(same, g, e))]
    assert not wrong, wrong[:3]


def test_registry_has_sql_for_real_names_only():
    assert set(registry.SQL) <= set(registry.QUERIES)
