"""Every registered query has SQL; a light cross-section is compared here, all of them by check_oracle.py."""
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import TABLES, canonical
from driftmark.plans import catalogue, oracle, stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")

LIGHT = ("event_car", "lm_tone", "lm_tone_joined", "mask_identity", "html_to_text", "parsed_answers", "scored_documents",
         "signal_delta", "sector_ic", "filing_selection", "press_release_links", "events_upsert", "weighted_kappa")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_queries_and_sql_have_the_same_names():
    assert set(catalogue.QUERIES) == set(oracle.ORACLE) and set(stored.QUERIES) == set(stored.ORACLE) and set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["signal", "season", "n", "ic"] and df.count() > 30


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_sql(spark, db, name):
    got, want = queries()[name](spark, FOLDER).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
