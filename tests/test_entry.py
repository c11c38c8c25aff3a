"""The driver contract: every query that has SQL must equal it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
import check_oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    got = spark_entry.queries()[name](spark, SF).toPandas()
    assert check_oracle.difference(got, database.execute(spark_entry.oracle_sql()[name]).df()) == ""


def test_flagship(spark):
    assert spark_entry.entry(spark).count() == 500


def test_stream_equals_batch(spark):
    live = spark_entry.queries()["stream_diagnostics"](spark, SF).toPandas().sort_values("sample_index")
    from spectraloom.operators.pca import diagnostics, fit_pca
    from spectraloom.plans.queries import BASIC
    from spectraloom.sources.tables import embedding_spectra

    s = embedding_spectra(spark, SF)
    batch = diagnostics(fit_pca(s, BASIC, 5), s).table.toPandas().sort_values("sample_index")
    assert (live.review_flag.to_numpy() == batch.review_flag.to_numpy()).all() and len(live) == 500
