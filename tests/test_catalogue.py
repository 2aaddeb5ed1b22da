"""Each query against the same in SQL, on the smallest tables."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugewright.plans import catalogue, reports, surface  # noqa: F401 (these add their queries to the catalogue)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return v.isoformat() if isinstance(v, datetime.date) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(r[c]) for c in columns] for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_time_functions_of_long_numbers(spark, tmp_path):
    """Numbers of more than six digits, which the tables in test sizes don't have."""
    path = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT n AS event_id, TIMESTAMP '2024-01-01 00:00:30' + INTERVAL 1 SECOND * n AS ts, '{{}}' AS props FROM (VALUES (0), (7), (999999), (1000000), (1000009), (5999999)) AS v(n) UNION ALL SELECT 12345678901, TIMESTAMP '2024-02-29 23:59:59.999999', '{{}}') TO '{path}' (FORMAT parquet)")
    got = catalogue.QUERIES["time_functions"](spark, str(tmp_path))
    want = duckdb.sql(catalogue.SQL["time_functions"].replace("FROM events", f"FROM '{path}'"))
    columns = sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted([plain(r[c]) for c in columns] for r in got.select(columns).collect()) == sorted([plain(r[c]) for c in columns] for r in rows)


def test_window_names_stay_whole(spark):
    from gaugewright.functions import exprs as E

    found = spark.sql("SELECT explode(array(5, 1000000, 1000001)) AS n, TIMESTAMP '2024-01-01' AS t").select(E.window_name(F.col("n"), F.col("t")).alias("name"))
    assert [r.name for r in found.collect()] == ["window_000005_20240101_000000", "window_1000000_20240101_000000", "window_1000001_20240101_000000"]
