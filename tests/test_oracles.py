"""Every registered analytics query against its SQL, on the small tables."""

import duckdb
import numpy as np
import pytest

from quadrille.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(p, columns):
    plain = lambda v: repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(map(tuple, p[columns].astype(object).where(p[columns].notna(), None).map(plain).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = c.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
