"""Performance metrics as aggregate expressions over a ledger (ts, returns, equity) or over trades (trade_return)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import by_time, finite

TINY = 1e-12
INF = float("inf")


def known(c: str) -> Column:
    return finite(F.col(c))


def sharpe(r: str, periods: float = 1.0, risk_free: float = 0.0) -> Column:
    """0 with fewer than two values or where nothing varies; sample deviation."""
    x = known(r)
    sd = F.stddev_samp(x)
    return F.when((F.count(x) < 2) | (sd < TINY), 0.0).otherwise((F.avg(x) - risk_free) / sd * math.sqrt(periods))


def sortino(r: str, periods: float = 1.0) -> Column:
    x = known(r)
    down = F.coalesce(F.stddev_samp(F.when(x < 0, x)), F.lit(0.0))
    usual = F.avg(x) / down * math.sqrt(periods)
    return F.when(F.count(x) < 2, 0.0).when(down < TINY, F.when(F.avg(x) > 0, INF).otherwise(0.0)).otherwise(usual)


def with_drawdown(ledger: DataFrame, keys: list[str], equity: str = "equity") -> DataFrame:
    """``ledger`` with peak and drawdown."""
    peak = F.max(equity).over(by_time(keys).rowsBetween(Window.unboundedPreceding, 0))
    return ledger.withColumn("peak", peak).withColumn("drawdown", F.col(equity) / F.col("peak") - 1)


def max_drawdown(drawdown: str = "drawdown") -> Column:
    return F.when(F.count(drawdown) < 2, 0.0).otherwise(F.min(drawdown))


def calmar(r: str, periods: float, drawdown: str = "drawdown") -> Column:
    deep = F.abs(max_drawdown(drawdown))
    return F.when(deep < TINY, 0.0).otherwise(F.avg(known(r)) * periods / deep)


def profit_factor(t: str) -> Column:
    x = known(t)
    won, lost = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)))
    return F.when(F.count(x) == 0, None).when(lost < TINY, F.when(won > 0, INF).otherwise(0.0)).otherwise(won / lost)


def trade_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    x = known("trade_return")
    return trades.groupBy(*keys).agg(
        F.count(x).alias("trades"), F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("win_rate"), F.avg(x).alias("avg_trade"), profit_factor("trade_return").alias("profit_factor")
    )


def summary(ledger: DataFrame, trades: DataFrame, keys: list[str], periods: float) -> DataFrame:
    """Nine figures for each run. ``ledger`` has returns, equity and drawdown; runs without trades have 0 of them."""
    bars = ledger.groupBy(*keys).agg(
        sharpe("returns", periods).alias("sharpe"), sortino("returns", periods).alias("sortino"), calmar("returns", periods).alias("calmar"), max_drawdown().alias("max_drawdown"),
        (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"),
    )
    joined = bars.join(trade_summary(trades, keys), keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trades", "win_rate", "avg_trade")})


def moments(r: str) -> dict[str, Column]:
    """n, mean, sample deviation, population skewness and kurtosis (3 for a normal)."""
    x = known(r)
    return {"n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x), "skew": F.skewness(x), "kurt": F.kurtosis(x) + 3}


def curve(ledger: DataFrame, keys: list[str], periods: float = 8760.0) -> DataFrame:
    """(keys, total_return, cagr, volatility, max_drawdown, sharpe); years of 365.25 days between first and last bar."""
    years = (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))) / (365.25 * 86400)
    out = with_drawdown(ledger, keys).groupBy(*keys).agg(
        (F.max_by("equity", "ts") - 1).alias("total_return"), years.alias("_y"), (F.stddev_samp("returns") * math.sqrt(periods)).alias("volatility"),
        max_drawdown().alias("max_drawdown"), sharpe("returns", periods).alias("sharpe"),
    )
    grown = F.when((F.col("_y") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), 1 / F.col("_y")) - 1)
    return out.withColumn("cagr", grown).drop("_y")


def panel_mean(runs: DataFrame, keys: list[str], periods: float) -> DataFrame:
    """Mean Sharpe and mean annual return over a panel's symbols from (symbol, keys, sharpe, equity_end, n)."""
    annual = F.when(F.col("equity_end") > 0, F.pow("equity_end", periods / F.col("n")) - 1).otherwise(-1.0)
    return runs.groupBy(*keys).agg(F.avg("sharpe").alias("mean_sharpe"), F.avg(annual).alias("mean_annual"))


def position_share(ledger: DataFrame, keys: list[str], position: str = "held") -> DataFrame:
    x = known(position)
    return ledger.groupBy(*keys).agg(F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("long_share"), F.avg(F.when(x.isNotNull(), (x < 0).cast("double"))).alias("short_share"))


def r_statistics(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(F.col("r") > 0).alias("wins"), (100 * F.avg((F.col("r") > 0).cast("double"))).alias("win_rate"),
        F.sum("r").alias("sum_r"), F.avg("r").alias("mean_r"), F.avg("bars").alias("mean_bars"),
    )
