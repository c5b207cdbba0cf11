"""Every registered query against its DuckDB oracle (sf0.001), the same check the driver runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import digest

from .conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_registered():
    assert len(QUERIES) >= 90
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF001)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    rel = con.sql(ORACLE[key])
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    cols = sorted(sdf.columns)
    assert digest(srows, cols)[0] == digest(drows, cols)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF001).count() >= 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "split", "n_tokens", "input_ids", "attention_mask"]
    assert df.count() > 0
