"""Queries over the star-schema tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_sql import SQL
from .functions import metrics, significance
from .operators import align, bars, chunks, features, kernels, paths, resample, unitroot
from .plans import causality, funnel, ledger, portfolio, strategies, verdict
from .schema import by_time, finite, keep_last
from .sources import runs_store, tables

KEYS = ["symbol"]
HOUR, DAY = 3600, 86400
WEIGHT = 0.01
#: How the long queries cut their series: several chunks for each at every scale.
LONG_DAYS, LONG_HOURS = chunks.Long(rows=500, step=DAY), chunks.Long(rows=200, step=HOUR)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, negative zero made zero."""
    return df.select(*((F.round(c, own.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth bars with segments, tradable marks and a threshold target of a hundredth."""
    found = bars.with_tradable(bars.with_segments(tables.smooth_bars(spark, sf_dir), KEYS, DAY), KEYS)
    strategy = strategies.make("threshold", {"window": 20, "k": 1.0})
    out = strategies.mask_targets(strategies.run_segmented(strategy, found, KEYS), strategy)
    return out.withColumn("target", F.col("target") * WEIGHT)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger(small(spark, sf_dir), KEYS, ledger.Costs(), capital=1e6, max_participation=0.1)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled four-hour bars to a run summary: resample, quality, z-score, threshold target, ledger, metrics."""
    ticks = tables.event_ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    found = bars.with_tradable(bars.with_segments(resample.bars_from_ticks(ticks, KEYS, 4 * HOUR, ["event_id"]), KEYS, 4 * HOUR), KEYS)
    strategy = strategies.make("threshold", {"window": 20, "k": 1.0})
    run = strategies.mask_targets(strategies.run_segmented(strategy, found, KEYS), strategy).withColumn("target", F.col("target") * WEIGHT)
    done = ledger.ledger(run, KEYS)
    return metrics.summary(done, ledger.trade_returns(done, KEYS), KEYS, 2190.0)


@query
def resample_hourly(spark, sf_dir):
    return rounded(tables.event_bars(spark, sf_dir).drop("taker_buy_volume"), 4)


@query
def resample_daily(spark, sf_dir):
    return rounded(tables.daily_bars(spark, sf_dir).drop("taker_buy_volume"), 2)


@query
def resample_bars_4h(spark, sf_dir):
    return rounded(resample.resample(tables.event_bars(spark, sf_dir), KEYS, "1h", "4h").drop("taker_buy_volume"), 4)


@query
def scan_range_pushdown(spark, sf_dir):
    """A date-only end takes in its whole day."""
    from .sources.lake import between

    found = tables.table(spark, sf_dir, "events").where(between("ts", "2024-01-05", "2024-01-06"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query
def dedup_keep_last(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return keep_last(rows, ["l_orderkey", "l_linenumber"], "seq").drop("seq")


@query
def quality_report(spark, sf_dir):
    return bars.quality_report(tables.event_bars(spark, sf_dir).withColumn("volume", F.when(F.col("trades") > 1, F.col("volume")).otherwise(0.0)), KEYS, HOUR)


@query
def gap_statistics(spark, sf_dir):
    return bars.gap_statistics(tables.event_bars(spark, sf_dir), KEYS, HOUR)


@query
def gap_segments(spark, sf_dir):
    found = bars.with_tradable(bars.with_segments(tables.event_bars(spark, sf_dir), KEYS, HOUR), KEYS)
    return found.select("symbol", "ts", "gap_start", "segment", "tradable")


@query
def rolling_features(spark, sf_dir):
    w, c = [*KEYS, "segment"], F.col("close")
    found = bars.with_segments(tables.daily_bars(spark, sf_dir), KEYS, DAY)
    up, down = features.directional_moves(w)
    out = found.select(
        "symbol", "ts", features.rolling_sigma(c, w, 20).alias("sigma"), features.zscore(c, w, 20).alias("z"), features.true_range(w).alias("tr"), up.alias("plus_dm"), down.alias("minus_dm"),
        features.regime(features.sigma_zscore(c, w, 20)).cast("int").alias("regime"),
    )
    return rounded(out, 4)


@query
def rolling_quantiles(spark, sf_dir):
    w = [*KEYS, "segment"]
    found = bars.with_segments(tables.daily_bars(spark, sf_dir), KEYS, DAY)
    return rounded(paths.rolling_quantiles(found.select("symbol", "ts", "segment", "close"), w, F.col("close"), 50, {"q5": 0.05, "q95": 0.95}).select("symbol", "ts", "q5", "q95"), 4)


@query
def ou_regression(spark, sf_dir):
    return rounded(features.ou_regression(tables.smooth_bars(spark, sf_dir), KEYS), 5)


@query
def half_life_filter(spark, sf_dir):
    found = features.half_life_ok(bars.with_segments(tables.smooth_bars(spark, sf_dir), KEYS, DAY), [*KEYS, "segment"], 50, 0.6, 0.75)
    return found.select("symbol", "ts", "hl_ok")


@query
def squeeze_filter(spark, sf_dir):
    found = bars.with_segments(tables.smooth_bars(spark, sf_dir), KEYS, DAY)
    return features.squeeze(F.col("close"), found, [*KEYS, "segment"], 20, 30, 0.8).select("symbol", "ts", "squeezed")


@query
def wilder_atr(spark, sf_dir):
    found = bars.with_segments(tables.daily_bars(spark, sf_dir), KEYS, DAY)
    out = kernels.with_ranges(found.select("symbol", "ts", "segment", "high", "low", "close"), [*KEYS, "segment"], 14)
    return rounded(out.select("symbol", "ts", F.nanvl("atr", F.lit(None).cast("double")).alias("atr")), 3)


@query
def adx(spark, sf_dir):
    found = bars.with_segments(tables.daily_bars(spark, sf_dir), KEYS, DAY)
    out = kernels.with_ranges(found.select("symbol", "ts", "segment", "high", "low", "close"), [*KEYS, "segment"], 14, 14)
    return rounded(out.select("symbol", "ts", F.nanvl("adx", F.lit(None).cast("double")).alias("adx")), 4)


@query
def funding_join(spark, sf_dir):
    """Events into the bars that hold them, in general and by arithmetic on the grid."""
    found, events = tables.event_bars(spark, sf_dir), tables.funding_events(spark, sf_dir)
    general = align.attach_funding(found, events, KEYS, HOUR, event_keys=[])
    grid = align.attach_funding(general.withColumnRenamed("funding_rate", "general"), events, KEYS, HOUR, on_grid=True, event_keys=[])
    return rounded(grid.select("symbol", "ts", "general", "funding_rate"), 10)


@query
def funding_join_median(spark, sf_dir):
    """Without a step each series' median interval is its bars' length: four-hourly bars of one symbol, daily of another, hourly of the rest."""
    hours = F.when(F.col("symbol") == "click", 4).when(F.col("symbol") == "view", 24).otherwise(1)
    found = tables.event_bars(spark, sf_dir).where(F.pmod(F.hour("ts"), hours) == 0)
    out = align.attach_funding(found, tables.funding_events(spark, sf_dir), KEYS, None, event_keys=[])
    return rounded(out.select("symbol", "ts", "funding_rate"), 10)


@query
def funding_matched(spark, sf_dir):
    return align.matched_events(tables.event_bars(spark, sf_dir), tables.funding_events(spark, sf_dir), KEYS, HOUR, event_keys=[])


@query
def funding_features(spark, sf_dir):
    found = align.attach_funding(tables.event_bars(spark, sf_dir), tables.funding_events(spark, sf_dir), KEYS, HOUR, on_grid=True, event_keys=[])
    scaled = found.withColumn("funding_rate", F.round(F.col("funding_rate") * 1e6, 3))
    return rounded(scaled.select("symbol", "ts", features.funding_mean(KEYS, 8).alias("ma"), features.funding_zscore(KEYS, 24).alias("z")), 5)


@query
def threshold_targets(spark, sf_dir):
    return small(spark, sf_dir).select("symbol", "ts", "target")


@query
def bracket_exits(spark, sf_dir):
    found = tables.smooth_bars(spark, sf_dir).withColumn("n", F.row_number().over(by_time(KEYS)))
    side = F.when(F.col("n") % 11 == 0, 1.0).when(F.col("n") % 7 == 0, -1.0).otherwise(0.0)
    found = found.withColumn("entry", side).withColumns({"stop_price": F.col("close") * (1 - 0.08 * F.col("entry")), "take_price": F.col("close") * (1 + 0.1 * F.col("entry"))})
    return kernels.with_brackets(found.select("symbol", "ts", "high", "low", "entry", "stop_price", "take_price"), KEYS, 5).select("symbol", "ts", "target")


@query
def ledger_bars(spark, sf_dir):
    out = book(spark, sf_dir).select("symbol", "ts", "held", "price_return", "turnover", "gross_return", "fee", "slippage", "returns", "equity", "drawdown")
    return rounded(out, 7, equity=5)


@query
def ledger_totals(spark, sf_dir):
    return rounded(ledger.totals(book(spark, sf_dir), KEYS), 6)


@query
def trade_returns(spark, sf_dir):
    return rounded(ledger.trade_returns(book(spark, sf_dir), KEYS), 7)


@query
def position_episodes(spark, sf_dir):
    return rounded(ledger.episodes(book(spark, sf_dir), KEYS), 7)


@query
def run_summary(spark, sf_dir):
    found = book(spark, sf_dir)
    out = metrics.summary(found, ledger.trade_returns(found, KEYS), KEYS, 365.0)
    return rounded(out.withColumn("profit_factor", finite(F.col("profit_factor"))), 5)


@query
def curve_metrics(spark, sf_dir):
    return rounded(metrics.curve(book(spark, sf_dir), KEYS, 365.0), 5)


@query
def position_shares(spark, sf_dir):
    return rounded(metrics.position_share(book(spark, sf_dir), KEYS), 6)


@query
def entry_exit_counts(spark, sf_dir):
    return ledger.transitions(book(spark, sf_dir), KEYS, F.col("ts") <= F.lit("1998-12-31").cast("timestamp_ntz"))


@query
def return_moments(spark, sf_dir):
    return rounded(book(spark, sf_dir).groupBy("symbol").agg(*(v.alias(k) for k, v in metrics.moments("returns").items())), 5)


@query
def harvest_book(spark, sf_dir):
    """A two-leg carry book on hourly bars."""
    found = align.attach_funding(tables.event_bars(spark, sf_dir), tables.funding_events(spark, sf_dir), KEYS, HOUR, on_grid=True, event_keys=[])
    strategy = strategies.make("funding_harvest", {"window": 8, "threshold_rate": 0.0, "weight": 0.5})
    run = strategies.run_segmented(strategy, bars.with_segments(found, KEYS, HOUR), KEYS)
    done = ledger.ledger(run, KEYS, legs=True, capital=10.0, max_participation=0.1)
    return rounded(ledger.totals(done, KEYS).join(ledger.is_delta_neutral(done, KEYS), KEYS), 7)


@query
def portfolio_mean(spark, sf_dir):
    return rounded(portfolio.equal_weight(book(spark, sf_dir), "symbol").select("ts", "returns", "in_book", "cap_hits", "equity"), 7, equity=5)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of eight lagged threshold rules on each symbol: long matrices of configurations."""
    ret = tables.smooth_bars(spark, sf_dir).select(*KEYS, "ts", ledger.price_return(KEYS).alias("r"), *(F.coalesce(F.signum(F.lag("close", 1).over(by_time(KEYS)) - F.lag("close", k).over(by_time(KEYS))), F.lit(0.0)).alias(f"s{k}") for k in range(2, 10)))
    each = F.explode(F.array(*(F.struct(F.lit(f"k{k}").alias("config_id"), (F.round(F.col("r") * F.col(f"s{k}"), 6)).alias("ret")) for k in range(2, 10)))).alias("e")
    return ret.select(*KEYS, "ts", each).select(*KEYS, "e.config_id", "ts", "e.ret")


@query
def overfitting_probability(spark, sf_dir):
    return rounded(significance.overfitting(matrix(spark, sf_dir), 6, KEYS), 6)


@query
def matrix_faults(spark, sf_dir):
    """Planted: a copy of one configuration, one that lacks the last times and one with holes."""
    found = matrix(spark, sf_dir)
    copied = found.where("config_id in ('k2', 'k3', 'k4')").replace({"k2": "copy", "k3": "short", "k4": "holes"}, subset=["config_id"])
    copied = copied.where("config_id <> 'short' or ts < timestamp_ntz'1998-01-01'").withColumn("ret", F.expr("if(config_id = 'holes' and ts > timestamp_ntz'1998-01-01', null, ret)"))
    return align.check_returns_matrix(found.unionByName(copied), KEYS)


@query
def purged_folds(spark, sf_dir):
    found = significance.purged_folds(tables.smooth_bars(spark, sf_dir), KEYS, 5, 10, 20)
    return found.groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def funnel_counts(spark, sf_dir):
    return funnel.funnel(tables.runs(spark, sf_dir).where("not screening"))


@query
def funnel_breakdown(spark, sf_dir):
    return funnel.breakdown(tables.runs(spark, sf_dir), "symbol")


@query
def funnel_reasons(spark, sf_dir):
    return funnel.reason_counts(tables.runs(spark, sf_dir))


@query
def top_survivors(spark, sf_dir):
    return rounded(funnel.survivors(tables.runs(spark, sf_dir), "sharpe", 10).select("config_id", "symbol", "sharpe"), 6)


@query
def run_group_counts(spark, sf_dir):
    return runs_store.group_counts(tables.runs(spark, sf_dir), "timeframe", "verdict")


@query
def query_runs(spark, sf_dir):
    out = runs_store.query_runs(tables.runs(spark, sf_dir), symbol="1-URGENT", status="verdict", order="dsr", limit=20, tie="seq")
    return rounded(out.select("config_id", "dsr", "trades"), 6)


@query
def pending_cells(spark, sf_dir):
    """Cells without a finished run: an anti join."""
    done = runs_store.completed_ids(tables.runs(spark, sf_dir).withColumn("data_version", F.lit("v1")), "v1", screening=False)
    cells = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("config_id"), "o_orderdate")
    return cells.join(done, "config_id", "left_anti")


@query
def results_upsert(spark, sf_dir):
    """New rows replace old ones of the same id."""
    old = tables.runs(spark, sf_dir).select("config_id", "symbol", "trades", "seq")
    new = old.where("seq % 4 = 0").withColumns({"trades": F.col("trades") + 1000, "seq": F.col("seq") + 10_000_000})
    merged = runs_store.upsert(old, new, "config_id", "seq")
    return merged.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("trades").alias("trades"), F.max("seq").alias("last_seq"))


@query
def symbols_complete(spark, sf_dir):
    from .sources.lake import complete_symbols

    found = tables.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"))
    return complete_symbols(found, "1995-01", "2000-12")


@query
def symbol_coverage(spark, sf_dir):
    """Months of orders as bars and months of urgent shipments as funding events."""
    from .sources.lake import coverage

    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), month("o_orderdate"), "o_orderkey")
    shipped = tables.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", month("l_shipdate"))
    funded = shipped.join(orders.drop("month"), F.col("l_orderkey") == F.col("o_orderkey")).select("symbol", "month")
    return coverage(orders.drop("o_orderkey"), funded, "1992-01", "1998-12")


@query
def funnel_thresholds(spark, sf_dir):
    return funnel.threshold_summary(tables.runs(spark, sf_dir), ["timeframe"])


@query
def deflated_sharpe(spark, sf_dir):
    """Its SQL has the normal distribution by integration."""
    return rounded(significance.deflated_sharpe(book(spark, sf_dir), KEYS, 10), 6)


@query
def run_verdicts(spark, sf_dir):
    found = book(spark, sf_dir)
    out = verdict.verdicts(found, ledger.trade_returns(found, KEYS), KEYS, 10, 365.0, significance.overfitting(matrix(spark, sf_dir), keys=KEYS))
    return out.withColumn("status", verdict.status())


@query
def mean_reversion_run(spark, sf_dir):
    """The full strategy: z-score, ATR brackets, state machine."""
    found = bars.with_tradable(bars.with_segments(tables.smooth_bars(spark, sf_dir), KEYS, DAY), KEYS)
    strategy = strategies.make("mean_reversion_filtered", {"k": 1.5, "max_bars": 20, "squeeze_ratio": 1.2, "squeeze_window": 30})
    run = strategies.mask_targets(strategies.run_segmented(strategy, found, KEYS), strategy).withColumn("target", F.col("target") * WEIGHT)
    return rounded(ledger.totals(ledger.ledger(run, KEYS), KEYS))


@query
def bracket_trade_list(spark, sf_dir):
    found = bars.with_segments(tables.smooth_bars(spark, sf_dir), KEYS, DAY)
    strategy = strategies.make("mean_reversion", {"k": 1.5, "max_bars": 20})
    trades = kernels.bracket_trades(strategies.run_segmented(strategy, found, KEYS), [*KEYS, "segment"], 2.0, 3.0, 20)
    return rounded(trades.withColumn("r", F.nanvl("r", F.lit(None).cast("double"))))


class NextBar(strategies.Parametrised):
    """Looks one bar ahead: what the causality harness must find."""

    name = "next_bar"

    def generate(self, bars: DataFrame, within: list[str]) -> DataFrame:
        return bars.withColumn("target", F.coalesce(F.signum(F.lead("close").over(by_time(within)) - F.col("close")), F.lit(0.0)))


@query
def causality_honest(spark, sf_dir):
    """No rows: the threshold strategy does not look ahead, on any series."""
    return causality.leaks(strategies.make("threshold"), tables.smooth_bars(spark, sf_dir), KEYS)


@query
def causality_leaks(spark, sf_dir):
    """A planted leak: a strategy that follows the next bar, on every series and all its times."""
    return causality.leaks(NextBar(), tables.smooth_bars(spark, sf_dir), KEYS)


@query
def hurst_exponent(spark, sf_dir):
    return rounded(kernels.hurst_exponent(tables.smooth_bars(spark, sf_dir), KEYS), 6)


@query
def series_statistics(spark, sf_dir):
    """Orders by AIC, which SQL can't choose: held against a regression for each order in tests."""
    found = tables.smooth_bars(spark, sf_dir)
    tested = unitroot.dickey_fuller(found, KEYS, LONG_DAYS).select(*KEYS, F.col("p_value").alias("adf_p"))
    return kernels.hurst_exponent(found, KEYS).join(tested, KEYS)


@query
def unit_root_one_lag(spark, sf_dir):
    """The statistic at a given order."""
    return rounded(unitroot.dickey_fuller(tables.smooth_bars(spark, sf_dir), KEYS, chunks.Long(rows=300, step=DAY), lags=1).select("symbol", "n", "lags", "tau"), 5)


def long_days(spark: SparkSession, sf_dir: str, source=tables.daily_bars) -> DataFrame:
    """Daily bars, numbered, with their segments."""
    return bars.with_segments(source(spark, sf_dir), KEYS, DAY, LONG_DAYS)


def long_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book() without a window or group over a whole series."""
    found = bars.with_tradable(long_days(spark, sf_dir, tables.smooth_bars), KEYS, long=LONG_DAYS)
    strategy = strategies.make("threshold", {"window": 20, "k": 1.0})
    out = strategies.mask_targets(strategies.run_segmented(strategy, found, KEYS, LONG_DAYS), strategy).withColumn("target", F.col("target") * WEIGHT)
    return ledger.ledger(out, KEYS, ledger.Costs(), capital=1e6, max_participation=0.1, long=LONG_DAYS)


@query
def gap_segments_long(spark, sf_dir):
    found = bars.with_tradable(bars.with_segments(tables.event_bars(spark, sf_dir), KEYS, HOUR, LONG_HOURS), KEYS, long=LONG_HOURS)
    return found.select("symbol", "ts", "gap_start", "segment", "tradable")


@query
def rolling_features_long(spark, sf_dir):
    def each(d: DataFrame, w: list[str]) -> DataFrame:
        c, (up, down) = F.col("close"), features.directional_moves(w)
        return d.withColumns({
            "sigma": features.rolling_sigma(c, w, 20), "z": features.zscore(c, w, 20), "tr": features.true_range(w), "plus_dm": up, "minus_dm": down,
            "regime": features.regime(features.sigma_zscore(c, w, 20)).cast("int"),
        })

    out = chunks.apply_with_halo(long_days(spark, sf_dir), KEYS, LONG_DAYS, 19, each)
    return rounded(out.select("symbol", "ts", "sigma", "z", "tr", "plus_dm", "minus_dm", "regime"), 4)


@query
def half_life_filter_long(spark, sf_dir):
    ok = lambda d, w: features.half_life_ok(d, w, 50, 0.6, 0.75)
    return chunks.apply_with_halo(long_days(spark, sf_dir, tables.smooth_bars), KEYS, LONG_DAYS, 50, ok).select("symbol", "ts", "hl_ok")


@query
def squeeze_filter_long(spark, sf_dir):
    calm = lambda d, w: features.squeeze(F.col("close"), d, w, 20, 30, 0.8)
    return chunks.apply_with_halo(long_days(spark, sf_dir, tables.smooth_bars), KEYS, LONG_DAYS, 48, calm).select("symbol", "ts", "squeezed")


@query
def rolling_quantiles_long(spark, sf_dir):
    """A window of 400 bars: its order is kept as it moves, so its length hardly counts."""
    each = lambda d, w: paths.rolling_quantiles(d, w, F.col("close"), 400, {"q5": 0.05, "q50": 0.5, "q95": 0.95})
    found = long_days(spark, sf_dir).select("symbol", "ts", "segment", "close", chunks.POS, chunks.LENGTH)
    return rounded(chunks.apply_with_halo(found, KEYS, LONG_DAYS, 399, each).select("symbol", "ts", "q5", "q50", "q95"), 4)


@query
def wilder_atr_long(spark, sf_dir):
    return rounded(paths.ranges(long_days(spark, sf_dir), KEYS, LONG_DAYS, 14).select("symbol", "ts", "atr"), 3)


@query
def adx_long(spark, sf_dir):
    return rounded(paths.ranges(long_days(spark, sf_dir), KEYS, LONG_DAYS, 14, 14).select("symbol", "ts", "adx"), 4)


@query
def bracket_exits_long(spark, sf_dir):
    found = chunks.numbered(tables.smooth_bars(spark, sf_dir), KEYS, LONG_DAYS).withColumn("n", F.col(chunks.POS) + 1)
    side = F.when(F.col("n") % 11 == 0, 1.0).when(F.col("n") % 7 == 0, -1.0).otherwise(0.0)
    found = found.withColumn("entry", side).withColumns({"stop_price": F.col("close") * (1 - 0.08 * F.col("entry")), "take_price": F.col("close") * (1 + 0.1 * F.col("entry"))})
    return paths.brackets(found, KEYS, 5, LONG_DAYS).select("symbol", "ts", "target")


@query
def ledger_bars_long(spark, sf_dir):
    out = long_book(spark, sf_dir).select("symbol", "ts", "held", "price_return", "turnover", "gross_return", "fee", "slippage", "returns", "equity", "drawdown")
    return rounded(out, 7, equity=5)


@query
def trade_returns_long(spark, sf_dir):
    return rounded(ledger.trade_returns(long_book(spark, sf_dir), KEYS, LONG_DAYS), 7)


@query
def position_episodes_long(spark, sf_dir):
    return rounded(ledger.episodes(long_book(spark, sf_dir), KEYS, LONG_DAYS), 7)


@query
def mean_reversion_run_long(spark, sf_dir):
    """The full strategy on cut series: smoothing, brackets, ledger, all from chunks."""
    found = bars.with_tradable(long_days(spark, sf_dir, tables.smooth_bars), KEYS, long=LONG_DAYS)
    strategy = strategies.make("mean_reversion_filtered", {"k": 1.5, "max_bars": 20, "squeeze_ratio": 1.2, "squeeze_window": 30})
    run = strategies.mask_targets(strategies.run_segmented(strategy, found, KEYS, LONG_DAYS), strategy).withColumn("target", F.col("target") * WEIGHT)
    return rounded(ledger.totals(ledger.ledger(run, KEYS, long=LONG_DAYS), KEYS))
