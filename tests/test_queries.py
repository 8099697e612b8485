"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tremor.jobs import registry

DIR = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "embeddings")
SLOW = {"fit_logreg", "fit_mlp", "model_table"}


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=lambda r: tuple((x is None, str(type(x)), x or 0) for x in r))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), sql.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_trained_models_report(spark):
    report = {r.label: r for r in registry.QUERIES["fit_logreg"](spark, DIR).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} < set(report) and 0 <= report["accuracy"].f1 <= 1
