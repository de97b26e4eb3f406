"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from signalframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_paired_bootstrap_in_full_equals_sql_and_joins_no_counts_to_draws(spark, con, monkeypatch):
    from signalframe.operators import resampling
    from signalframe.plans.prediction_queries import FULL_AUC, REPS

    def joined(*_):
        raise AssertionError("a row for each count and repetition")

    monkeypatch.setattr(resampling, "auc", joined)
    sql = catalog.oracle_sql()["r05_paired_bootstrap"].replace(f"range({REPS})", f"range({FULL_AUC})")
    got = catalog.queries()["r05_paired_bootstrap_full"](spark, SF).toPandas()
    assert f"range({FULL_AUC})" in sql and rows_of(got) == rows_of(con.execute(sql).df())


def test_entry_works_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_logistic_arm_reads_its_windows_from_a_table(spark):
    plan = catalog.queries()["x02_logistic_arm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_log_round_trip_writes_more_than_one_file(spark):
    from pathlib import Path

    from signalframe.session import scratch_dir

    folder, adaptive = Path(scratch_dir(spark)), spark.conf.get("spark.sql.adaptive.enabled")
    before = set(folder.glob("log-*"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put these few rows together
    try:
        assert catalog.queries()["s02_log_round_trip"](spark, SF).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    (log,) = set(folder.glob("log-*")) - before
    assert len(list(log.glob("part-*"))) > 1
