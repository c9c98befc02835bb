"""Bars, events and runs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import bars_from_ticks

TIE_BREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id")


def event_bars(spark: SparkSession, sf_dir: str, step: int = 3600) -> DataFrame:
    """Hourly bars of each event type, with holes at small scales."""
    return bars_from_ticks(event_ticks(spark, sf_dir), ["symbol"], step, ["event_id"])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each return flag, almost without holes."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"), *TIE_BREAK
    )
    return bars_from_ticks(ticks, ["symbol"], 86400, TIE_BREAK)


def smooth_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars around the volume-weighted price: a series calm enough for a ledger."""
    mean = F.round(F.col("quote_volume") / F.col("volume"), 4)
    return daily_bars(spark, sf_dir).withColumns({"close": mean, "open": mean, "high": F.round(mean * 1.05, 4), "low": F.round(mean * 0.95, 4)})


def funding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return signups.select("ts", ((F.col("value") - 50) / 1e6).alias("rate"), F.lit(8).cast("long").alias("interval_hours"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results-store rows by arithmetic on orders."""
    k = F.col("o_orderkey")
    failed, screened = k % 11 == 0, k % 13 == 0
    part = lambda n, base: (k % n) / float(base)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), k.cast("string")).alias("config_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("timeframe"), F.lit("mean_reversion").alias("strategy"),
        F.when(failed, 0).otherwise(k % 301).alias("trades"), part(1009, 1000).alias("dsr"), part(97, 970).alias("p_value"), F.when(k % 7 != 0, part(89, 100)).alias("pbo"),
        (F.col("o_totalprice") / 1e5 - 1).alias("sharpe"), F.when(failed, "boom").otherwise("").alias("error"), screened.alias("screening"),
        (~failed & ~screened & (k % 5 != 0)).alias("alive"), F.when(screened, 200).otherwise(1000).cast("long").alias("n_permutations"),
        F.when(k % 17 == 0, "{broken").when(k % 19 == 0, '{"min_trades": 50, "min_dsr": 0.9, "max_p_value": 0.1, "max_pbo": 0.6}')
        .otherwise('{"min_trades": 100, "min_dsr": 0.95, "max_p_value": 0.05, "max_pbo": 0.5}').alias("thresholds_json"),
        F.when(k % 3 == 0, "too few trades | DSR low").when(k % 3 == 1, "DSR low").otherwise("").alias("reasons"), k.alias("seq"),
    )
