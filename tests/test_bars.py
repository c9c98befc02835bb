from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barforge import schema
from barforge.operators import align, bars as B
from barforge.operators.resample import resample

from . import helpers

K = ["symbol"]


def test_minutes_to_hours(spark):
    found = helpers.bars(spark, [100 + i for i in range(600)], step=60)
    out = resample(found, K, "1m", "1h").orderBy("ts").collect()
    assert len(out) == 10 and out[0]["open"] == 100 and out[0]["close"] == 159 and out[0]["volume"] == 600
    assert resample(found, K, "1m", "1m") is found
    with pytest.raises(ValueError):
        resample(found, K, "1m", "7m")


def test_missing_values_in_buckets(spark):
    found = helpers.bars(spark, range(10, 70), step=60).withColumn("volume", F.lit(None).cast("double")).withColumn("open", F.when(F.minute("ts") > 0, F.col("open")))
    row = resample(found, K, "1m", "1h").first()
    assert row["volume"] == 0 and row["open"] == 10  # the first open that is there, which is the close before


def test_dirty_bars(spark):
    ok = (1.0, 2.0, 0.5, 1.5, 10.0)
    bad = [(1.0, 2.0, 0.5, 1.5, 0.0), (1.0, 2.0, 0.5, 1.5, None), (1.0, 0.4, 0.5, 0.45, 1.0), (1.0, 0.9, 0.5, 0.8, 1.0), (1.0, None, 0.5, 1.5, 1.0), (1.0, 2.0, 0.0, 1.5, 1.0)]
    rows = [("A", datetime(2024, 1, 1) + timedelta(minutes=i), *r) for i, r in enumerate([ok, *bad])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    assert [r[0] for r in df.orderBy("ts").select(B.dirty()).collect()] == [False] + [True] * 6
    row = B.quality_report(df, K, 60).first()
    assert (row["total"], row["zero_volume"], row["anomalous"], row["bad_rows"], row["gaps"]) == (7, 2, 4, 6, 0)


def test_gaps_and_segments(spark):
    found = B.with_tradable(B.with_segments(helpers.bars(spark, range(100, 180), skip={40}), K, 3600), K).orderBy("ts").collect()
    assert [r["segment"] for r in found] == [0] * 40 + [1] * 39
    assert [i for i, r in enumerate(found) if not r["tradable"]] == [39]
    assert tuple(B.gap_statistics(helpers.bars(spark, range(9), skip={3, 4}), K, 3600).first())[1:] == (1, 2)


def test_wide_gap_masks(spark):
    found = B.with_gaps(helpers.bars(spark, range(100, 110), skip={5}), K, 3600)
    mask = lambda back, ahead: [i for i, r in enumerate(found.select("ts", B.gap_mask(K, back, ahead).alias("m")).orderBy("ts").collect()) if r["m"]]
    assert mask(1, 0) == [4] and mask(2, 1) == [3, 4, 5] and mask(0, 2) == [5, 6]


def test_normalising_keeps_the_last_good_row(spark):
    t = datetime(2024, 1, 1)
    rows = [("A", t, "1", "2", "0.5", "1.5", "1", "1", "1", "1", 0), ("A", t, "x", "2", "0.5", "1.5", "1", "1", "1", "1", 2), ("A", t, "3", "4", "2.5", "3.5", "NaN", "1", "1", "1", 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open string, high string, low string, close string, volume string, quote_volume string, trades string, taker_buy_volume string, n int")
    out = schema.normalize_bars(df, K, "n").collect()
    assert len(out) == 1 and out[0]["open"] == 3 and out[0]["volume"] is None
    with pytest.raises(ValueError):
        schema.normalize_bars(df.drop("close"), K, "n")


def events(spark, *rows):
    return spark.createDataFrame([("A", t, float(r)) for t, r in rows], "symbol string, ts timestamp_ntz, rate double")


def test_funding_of_days(spark):
    t = datetime(2024, 1, 1)
    days = helpers.bars(spark, [1, 2, 3], step=86400)
    found = events(spark, *((t + timedelta(hours=8 * i), (i + 1) * 1e-4) for i in range(6)))
    for grid in (True, False):
        out = align.attach_funding(days, found, K, 86400, on_grid=grid).orderBy("ts").collect()
        assert [round(r["funding_rate"], 10) for r in out] == [6e-4, 15e-4, 0]


def test_funding_in_a_hole_is_dropped(spark):
    t = datetime(2024, 1, 1)
    holed = helpers.bars(spark, [1, 2, 3, 4], step=86400, skip={1, 2})
    found = events(spark, (t + timedelta(hours=5), 1e-4), (t + timedelta(days=1), 2e-4), (t + timedelta(days=3), 3e-4), (t - timedelta(hours=1), 9e-4))
    out = align.attach_funding(holed, found, K, 86400).orderBy("ts").collect()
    assert [round(r["funding_rate"], 10) for r in out] == [1e-4, 3e-4]
    assert align.matched_events(holed, found, K, 86400).first()["matched"] == 2
    by_median = align.attach_funding(holed, found, K, None).orderBy("ts").collect()  # the only interval is three days
    assert [round(r["funding_rate"], 10) for r in by_median] == [3e-4, 3e-4]


def test_matrix_faults(spark):
    t = datetime(2024, 1, 1)
    rows = [(c, t + timedelta(hours=i), v) for c, vs in {"a": [1.0, 2.0], "b": [1.0, 2.0], "c": [2.0, float("nan")], "d": [1.0]}.items() for i, v in enumerate(vs)]
    found = {tuple(r) for r in align.check_returns_matrix(spark.createDataFrame(rows, "config_id string, ts timestamp_ntz, ret double")).collect()}
    assert found == {("equal to another", "a"), ("equal to another", "b"), ("value not finite", "c"), ("other times", "d")}


def test_means_over_a_union_of_times(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 3.0), ("A", 2, 5.0)], "symbol string, ts int, x double")
    assert [tuple(r) for r in align.union_of_times(df, "symbol", ["x"]).orderBy("ts").collect()] == [(1, 2, 2.0), (2, 1, None)]


@pytest.mark.parametrize("rows", [1, 3, 10_000])
@pytest.mark.parametrize("step", [3600, None])
@pytest.mark.parametrize("keyed", [True, False])
def test_events_find_their_bars_in_any_buckets(spark, rows, step, keyed):
    """Bars with holes, events on bounds, before, between and after them, a lone bar, one symbol with most of the rows."""
    import bisect
    import random
    import statistics

    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    times = {"A": [t0 + timedelta(hours=i) for i in range(60) if i % 11], "B": [t0 + timedelta(hours=6 * i) for i in range(9)], "C": [t0 + timedelta(hours=7)]}
    df = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts], "symbol string, ts timestamp_ntz")
    events = [(rng.choice("AAAABC"), t0 + timedelta(minutes=rng.choice([0, 30, 1]) + 60 * rng.randrange(-3, 66)), float(i)) for i in range(150)]
    given = spark.createDataFrame(events, "symbol string, ts timestamp_ntz, rate double")
    want = []
    for s, ts in times.items():
        gaps = [(b - a).total_seconds() for a, b in zip(ts, ts[1:])]
        width = timedelta(seconds=step or (statistics.median(gaps) if gaps else 1e-6))
        for own, at, rate in events:
            k = bisect.bisect_right(ts, at) - 1
            if (own == s or not keyed) and k >= 0 and at < ts[k] + width:
                want.append((s, at, rate, ts[k]))
    found = align.containing_bar(df, given if keyed else given.drop("symbol"), ["symbol"], step, None if keyed else [], rows=rows)
    assert sorted(map(tuple, found.collect())) == sorted(want)
