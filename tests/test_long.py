"""Cut series against whole ones: the same values whatever the size of the chunks, and no partition beyond a chunk and its halo."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barforge.operators import bars, chunks, features, kernels, paths
from barforge.operators.chunks import CHUNK, POS, Long
from barforge.plans import ledger, strategies

from . import helpers

K = ["symbol"]
HOUR = 3600


@pytest.fixture(scope="module")
def series(spark):
    """Two series with holes, flat stretches, missing prices and a third of one bar."""
    rng = random.Random(8)
    x = helpers.ou(160, theta=0.2)
    one = helpers.bars(spark, x, skip={7, 8, 21, 49, 50, 51, 98})
    two = helpers.bars(spark, [100 + rng.randrange(5) for _ in range(90)], symbol="B", skip={14, 70})
    lone = helpers.bars(spark, [5, 5, 6], symbol="C")
    df = one.unionByName(two).unionByName(lone)
    return bars.with_tradable(bars.with_segments(df, K, HOUR), K).persist()


def rows(df, *columns, digits=9):
    out = []
    for r in df.select("symbol", "ts", *columns).collect():
        out.append(tuple(round(v, digits) + 0.0 if isinstance(v, float) and v == v else None if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


SIZES = [1, 7, 1000]


@pytest.mark.parametrize("size", SIZES)
def test_numbers_segments_and_marks(spark, series, size):
    long = Long(size, HOUR)
    raw = series.drop("gap_start", "segment", "tradable")
    found = bars.with_tradable(bars.with_segments(raw, K, HOUR, long), K, long=long)
    assert rows(found, "gap_start", "segment", "tradable") == rows(series, "gap_start", "segment", "tradable")
    by = {}
    for s, ts, pos, n in rows(found, POS, "_len"):
        by.setdefault(s, []).append((pos, ts, n))
    assert all(sorted(v) == [(i, t, len(v)) for i, (_, t, _) in enumerate(sorted(v))] for v in by.values())


@pytest.mark.parametrize("size", SIZES)
def test_windows_with_a_halo(spark, series, size):
    long, w = Long(size, HOUR), [*K, "segment"]

    def each(d, within):
        c = F.col("close")
        d = d.withColumns({"sigma": features.rolling_sigma(c, within, 5), "z": features.zscore(c, within, 5), "tr": features.true_range(within)})
        d = features.half_life_ok(d, within, 12, 0.1, 50.0)
        d = features.squeeze(c, d, within, 5, 6, 0.9)
        return paths.rolling_quantiles(d, within, c, 9, {"q_low": 0.1, "q_mid": 0.5})

    names = ["sigma", "z", "tr", "hl_ok", "squeezed", "q_low", "q_mid"]
    cut = chunks.apply_with_halo(chunks.numbered(series, K, long), K, long, 14, each)
    assert rows(cut, *names) == rows(each(series, w), *names)
    widest = chunks.apply_with_halo(chunks.numbered(series, K, long), K, long, 14, lambda d, k: d.withColumn("n", F.count("*").over(bars.Window.partitionBy(*K, CHUNK))), after=2)
    assert widest.agg(F.max("n")).first()[0] <= size + 16


@pytest.mark.parametrize("size", SIZES)
def test_running_values(spark, series, size):
    long = Long(size, HOUR)
    df = series.withColumn("x", F.when(F.minute("ts") == 0, F.col("close") % 7 - 3)).withColumn("x", F.when(F.hour("ts") % 5 > 0, F.col("x")))
    upto = bars.by_time(K).rowsBetween(bars.Window.unboundedPreceding, 0)
    whole = df.withColumns({"s": F.sum("x").over(upto), "p": F.product(1 + F.col("x") / 10).over(upto), "m": F.max("x").over(upto)})
    cut = chunks.running(chunks.numbered(df, K, long), K, long, {"s": F.col("x")}, {"p": 1 + F.col("x") / 10}, {"m": F.col("x")})
    assert rows(cut, "s", "p", "m", digits=7) == rows(whole, "s", "p", "m", digits=7)


@pytest.mark.parametrize("size", SIZES)
def test_smoothing(spark, series, size):
    """Holes on the edges of chunks and runs too short to begin."""
    long = Long(size, HOUR)
    df = series.select("symbol", "ts", "segment", "high", "low", "close", F.when(F.pmod(F.hash("ts"), F.lit(23)) > 0, F.col("close")).alias("x"))
    for length in (1, 4):
        cut = paths.smoothed(chunks.numbered(df, K, long), K, {"rma": "x"}, length, long)
        assert rows(cut, "rma") == rows(kernels.with_wilder(df, [*K, "segment"], "x", length), "rma")
    whole = kernels.with_ranges(df, [*K, "segment"], 5, 4)
    assert rows(paths.ranges(chunks.numbered(df, K, long), K, long, 5, 4), "atr", "adx", digits=8) == rows(whole, "atr", "adx", digits=8)


def test_affine_maps_compose():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(60)
    x[[5, 30]] = np.nan
    want = kernels.wilder(x, 4)
    seeds, values = np.full(60, np.nan), np.full(60, np.nan)
    nth = 0
    for i in range(60):
        nth = nth + 1 if x[i] == x[i] else 0
        if nth == 4:
            seeds[i] = x[i - 3 : i + 1].mean()
        elif nth > 4:
            values[i] = x[i]
    for size in (1, 3, 17, 60):
        state, got = np.nan, []
        for k in range(0, 60, size):
            a, b = paths.affine_path(seeds[k : k + size], values[k : k + size], 4)
            got += [(ai * state if ai else 0.0) + bi for ai, bi in zip(a, b, strict=True)]
            state = got[-1]
        assert np.allclose(got, want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize(("size", "max_bars"), [(1, 3), (7, 1), (7, 40), (1000, 3)])
def test_brackets(spark, series, size, max_bars):
    """Trades longer than a chunk, cut off by segments, signals on every bar, levels that protect nothing."""
    long = Long(size, HOUR)
    pick = F.pmod(F.hash("ts", "symbol"), F.lit(10))
    df = series.select("symbol", "ts", "segment", "high", "low", "close", F.when(pick < 4, 1.0).when(pick < 7, -1.0).when(pick == 7, F.lit(None)).otherwise(0.0).alias("entry"))
    df = df.withColumns({"stop_price": F.when(pick != 1, F.col("close") - 2.5 * F.col("entry")), "take_price": F.when(pick != 5, F.col("close") + 2 * F.col("entry"))})
    want = rows(kernels.with_brackets(df, [*K, "segment"], max_bars), "target")
    assert rows(paths.brackets(chunks.numbered(df, K, long), K, max_bars, long), "target") == want
    assert len({r[2] for r in want}) == 3
    with pytest.raises(Exception, match="entries must be"):
        paths.brackets(chunks.numbered(df.withColumn("entry", F.lit(0.5)), K, long), K, max_bars, long).collect()


def test_steps_where_walks_meet():
    at, free = np.array([3, 4, 5, 9]), np.array([6, 10, 6, 12])
    assert paths.walk_steps(at, free, 10) == ([3, 4, 9], [12, 10, 12])
    assert paths.walk_steps(np.array([], dtype=int), np.array([], dtype=int), 10) == ([], [])


@pytest.mark.parametrize("size", SIZES)
def test_ledger_trades_and_episodes(spark, series, size):
    long = Long(size, HOUR)
    df = series.where("symbol <> 'C'").withColumn("target", F.expr("case pmod(hash(ts), 5) when 0 then 0.5 when 1 then -0.25 when 2 then null else 0.0 end"))
    columns = ["held", "price_return", "turnover", "gross_return", "fee", "slippage", "returns", "equity", "peak", "drawdown"]
    whole, cut = ledger.ledger(df, K), ledger.ledger(df, K, long=long)
    assert rows(cut, *columns) == rows(whole, *columns)
    plain = lambda d: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)
    assert plain(ledger.trade_returns(cut, K, long)) == plain(ledger.trade_returns(whole, K))
    assert plain(ledger.episodes(cut, K, long)) == plain(ledger.episodes(whole, K))
    with pytest.raises(Exception, match="fewer than two bars"):
        ledger.ledger(helpers.bars(spark, [5.0], symbol="L").withColumn("target", F.lit(0.0)), K, long=long).collect()


@pytest.mark.parametrize(("name", "params"), [
    ("threshold", {"window": 6}), ("mean_reversion", {"window": 8, "atr_len": 4, "k": 1.0, "max_bars": 9, "use_hl_filter": True, "hl_window": 10, "hl_min": 0.1}),
    ("mean_reversion_filtered", {"window": 6, "atr_len": 4, "max_bars": 5, "quantile_window": 10, "coverage": 60.0, "squeeze_ratio": 1.1, "squeeze_window": 5, "adx_max": 60, "adx_period": 4}),
])
def test_strategies_on_cut_series(spark, series, name, params):
    strategy, size = strategies.make(name, params), 30
    whole = rows(strategies.run_segmented(strategy, series, K), "target")
    assert rows(strategies.run_segmented(strategy, series, K, Long(size, HOUR)), "target") == whole and len({r[2] for r in whole}) > 1


def test_sliding_window_keeps_its_order():
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal(3000), 1)  # many ties
    x[rng.integers(0, 3000, 20)] = np.nan
    for n in (1, 2, 37, 1500):
        got = np.array(list(paths.sliding_quantiles(x, n, [0.0, 0.3, 1.0], block=16)))
        assert np.array_equal(got, np.array(list(paths.sliding_quantiles(x, n, [0.0, 0.3, 1.0]))), equal_nan=True)
        for i in rng.integers(0, 3000, 60):
            part = x[max(0, i - n + 1) : i + 1]
            full = len(part) == n and not np.isnan(part).any()
            assert np.allclose(got[i], np.quantile(part, [0.0, 0.3, 1.0])) if full else np.isnan(got[i]).all()


def test_bars_far_apart_and_at_odd_times(spark):
    """Numbers follow the order of time, however sparse the series."""
    times = [datetime(2020, 1, 1) + timedelta(seconds=s) for s in (0, 1, 5, 40_000, 40_001, 90_000_000)]
    df = spark.createDataFrame([("A", t, float(i)) for i, t in enumerate(times)], "symbol string, ts timestamp_ntz, x double")
    found = {r["ts"]: (r[POS], r["_len"]) for r in chunks.numbered(df, K, Long(2, 1)).collect()}
    assert found == {t: (i, 6) for i, t in enumerate(times)}


@pytest.mark.parametrize(("name", "params"), [("threshold", {"window": 5}), ("mean_reversion", {"window": 5, "atr_len": 3, "k": 1.0, "max_bars": 6})])
def test_causality_on_cut_series(spark, name, params):
    from barforge.plans import causality

    df, strategy = helpers.bars(spark, helpers.ou(40, theta=0.2)), strategies.make(name, params)
    plain = lambda long: sorted(map(tuple, causality.compared(strategy, df, K, long=long).collect()), key=repr)
    whole = plain(None)
    assert plain(Long(9, HOUR)) == whole and all(r[-1] for r in whole)


def test_sweep_on_cut_series(spark, tmp_path):
    from barforge.plans import sweep
    from barforge.sources import experiment, runs_store

    base = experiment.Experiment("h", "mean_reversion", {"window": 8, "atr_len": 4, "k": 1.0}, "1h", "2024-01-01", validation={"n_permutations": 20})
    cells = experiment.expand(base, ["A"], ["1h"], {"max_bars": [5, 9]})
    bars_of = helpers.bars(spark, helpers.ou(120, theta=0.2), skip={30, 31, 77})
    found = []
    for i, rows in enumerate((None, 25)):
        prepared = sweep.prepare(bars_of, "1h", "1h", rows=rows).persist()
        assert sweep.sweep(cells, lambda *_, p=prepared: p, str(tmp_path / f"runs{i}"), spark, "v1", causal=False, rows=rows)["failed"] == 0
        found.append(sorted((r["config_id"], r["trades"], round(r["sharpe"], 9), round(r["total_return"], 9), r["p_value"]) for r in runs_store.read_runs(spark, str(tmp_path / f"runs{i}")).collect()))
    assert found[0] == found[1] and all(r[1] > 3 for r in found[0])
