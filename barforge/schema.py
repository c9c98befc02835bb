"""Schemas, time steps and the null rule.

NaN and infinities become null at every scan and after every division; inside the library null is the only missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PRICES = ("open", "high", "low", "close")
AMOUNTS = ("volume", "quote_volume", "trades", "taker_buy_volume")
BAR_COLUMNS = ("ts", *PRICES, *AMOUNTS)
BARS = T.StructType([T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in PRICES + AMOUNTS)])
FUNDING = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("rate", T.DoubleType()), T.StructField("interval_hours", T.LongType())])

#: Seconds of each time frame (fixed values).
STEP_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def step_seconds(timeframe: str) -> int:
    if timeframe not in STEP_SECONDS:
        raise ValueError(f"unknown time frame {timeframe!r}")
    return STEP_SECONDS[timeframe]


def periods_per_year(timeframe: str) -> int:
    """Bars in 365 days."""
    return round(365 * 86400 / step_seconds(timeframe))


def finite(value: Column) -> Column:
    """``value``, or null where it is NaN or infinite."""
    return F.when(F.abs(value) < float("inf"), value)  # NaN is greater than infinity in Spark


def ratio(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a, b))


def by_time(keys: list[str], order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(window, n: int):
    """The frame of the last ``n`` rows, the current one among them."""
    return window.rowsBetween(1 - n, 0)


def normalize_bars(raw: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Canonical bars: numbers coerced, rows without a price dropped, and of equal times the last by ``sequence`` kept.

    A bad duplicate can't shadow a good row, since it is dropped first. Missing columns raise.
    """
    missing = [c for c in BAR_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    coerced = raw.select(*keys, "ts", *(finite(F.col(c).cast("string").try_cast("double")).alias(c) for c in PRICES + AMOUNTS), F.col(sequence).alias("_seq"))
    return keep_last(coerced.dropna(subset=list(PRICES)), [*keys, "ts"], "_seq").drop("_seq")


def keep_last(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest ``sequence``: one shuffle, combined before it."""
    own = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*own), F.col(sequence)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in own)).select(*rows.columns)


#: The results store's version and columns (fixed values).
RUNS_VERSION = "2.0"
RUN_STRINGS = (
    "config_id experiment_id symbol timeframe strategy params_json start end error data_version reasons warnings thresholds_json costs_json"
).split()
RUN_LONGS = "index trades n_trials n_permutations".split()
RUN_DOUBLES = "duration_s sharpe dsr p_value pbo max_dd total_return cost_total".split()
RUN_BOOLEANS = "screening alive".split()
RUNS = T.StructType(
    [T.StructField(c, T.StringType()) for c in RUN_STRINGS]
    + [T.StructField(c, T.LongType()) for c in RUN_LONGS]
    + [T.StructField(c, T.DoubleType()) for c in RUN_DOUBLES]
    + [T.StructField(c, T.BooleanType()) for c in RUN_BOOLEANS]
)
