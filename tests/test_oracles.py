"""Every query against its DuckDB SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from recordloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


#: Queries that SQL can't express, with what their rows must be (the operator is tried against every window in test_contracts).
BY_HAND = {"excerpt_hits": lambda df: list(df.columns) == ["doc_id", "excerpt"] and 0 < len(df) <= 20 and (df["excerpt"].str.len() <= 400).all()}


def _plain(df: pd.DataFrame) -> list:
    show = lambda x: None if x is None or x is pd.NA or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)
    return sorted((tuple(show(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in BY_HAND:
        assert BY_HAND[name](found)
        return
    asked = sql.execute(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(asked.columns)
    assert _plain(found) == _plain(asked)
