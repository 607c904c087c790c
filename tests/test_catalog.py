"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name not in catalog.ORACLES:
        return
    cursor = oracle.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted(([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)] for r in cursor.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in sorted(columns)] for r in rows), key=repr) == expected
