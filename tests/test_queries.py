"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from folioscope.plans.registry import QUERIES, SQL

DIR = os.environ.get("QUERY_DIR", "/root/testdata/sf0.001")
TABLES = "lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    plain = lambda v: None if not isinstance(v, list) and pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), c.sql(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)
