"""The whole evaluation on the smallest tables, in one piece and with every large-group path forced."""
import os

import pytest
from pyspark.sql import functions as F

from driftmark.plans.catalogue import SIGNALS, split_returns
from driftmark.plans.study import Backtest, with_scores
from driftmark.plans.warehouse import LATE_CUTOFF, Warehouse

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def warehouse(spark):
    return Warehouse(spark, FOLDER)


def run(w, slices=None):
    return Backtest(w.sector_study, SIGNALS, training_cutoff=LATE_CUTOFF, factors=split_returns(w), slices=slices,
                    min_names_per_leg=1, min_history=20)


def test_summary_is_the_same_with_sliced_groups(warehouse):
    whole = {r.signal: r.asDict() for r in run(warehouse).summary().collect()}
    cut = {r.signal: r.asDict() for r in run(warehouse, 9).summary().collect()}
    assert set(whole) == set(SIGNALS)
    for signal, row in whole.items():
        assert list(row) == list(cut[signal])
        for name, value in row.items():
            assert cut[signal][name] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value), name
    assert whole["tone"]["event_net_days"] > 200 and whole["tone"]["seasonal_periods"] > 10 and "ffe_t_Mom" in whole["tone"]


def test_result_tables_are_written(spark, warehouse, tmp_path):
    bt = run(warehouse)
    bt.write(str(tmp_path), "tone")
    names = {"summary", "ic_by_season", "daily_returns", "holdings", "events_scored", "entry_delay", "meta"}
    assert names <= set(os.listdir(tmp_path))
    daily = spark.read.parquet(str(tmp_path / "daily_returns"))
    assert "tone_event_time_net" in daily.columns and "market_MKT" in daily.columns
    assert daily.count() == daily.select("date").distinct().count()
    meta = spark.read.parquet(str(tmp_path / "meta")).first()
    assert meta.n_tickers == 5 and meta.has_factors and meta.median_days_to_trade >= 0
    assert sorted(r.delay_days for r in spark.read.parquet(str(tmp_path / "entry_delay")).collect()) == [0, 5, 10, 20, 40]


def test_no_known_signal_is_refused(warehouse):
    with pytest.raises(ValueError):
        Backtest(warehouse.sector_study, ["absent"], training_cutoff=LATE_CUTOFF)


def test_scores_join_on_the_left(spark):
    events = spark.createDataFrame([("a",), ("b",)], "event_id string")
    tone = spark.createDataFrame([("a", 1.0), ("z", 9.0)], "event_id string, tone double")
    lm = spark.createDataFrame([("b", 2.0)], "event_id string, lm double")
    got = {r.event_id: (r.tone, r.lm) for r in with_scores(events, tone, lm).collect()}
    assert got == {"a": (1.0, None), "b": (None, 2.0)}


def test_delay_zero_is_the_book_itself(warehouse):
    book = run(warehouse).event_time
    plain = {(r.signal, r.pos): r.net for r in book.returns.collect()}
    zero = {(r.signal, r.pos): r.net for r in book.delayed_returns([0]).filter(F.col("delay_days") == 0).collect()}
    assert zero == pytest.approx(plain)


def test_kept_rows_and_latest_documents_are_read_as_written(warehouse):
    kept, lazy = run(warehouse), run(warehouse)
    kept.keep_rows()
    for frame in (kept.rows, kept.seasonal.latest):
        assert not any("lineitem" in f or "orders" in f for f in frame.inputFiles())
    columns = ["signal", "event_id", "t0_pos", "value", kept.study.target]
    assert sorted(map(tuple, kept.rows.select(*columns).collect())) == sorted(map(tuple, lazy.rows.select(*columns).collect()))


def test_limits_open_the_positions_of_the_legs(warehouse):
    book = run(warehouse).event_time
    want = book.documents().filter("leg <> 0").groupBy("signal", "ticker", "t0_pos", "leg").count()
    assert sorted(map(tuple, book.positions.collect())) == sorted(map(tuple, want.collect()))
    assert book.positions.count() > 20
