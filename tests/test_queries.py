"""Every registered query against its SQL counterpart."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("key", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_matches_sql(spark, connection, key):
    assert compare(spark, connection, FOLDER, key, entry.queries()[key], entry.oracle_sql()[key]) is None


def test_entry_gives_duplicates(spark):
    df = entry.entry(spark)
    assert df.columns == ["crypto_hash", "set_size", "role", "path", "size_bytes", "mtime"]
    assert df.count() > 0
