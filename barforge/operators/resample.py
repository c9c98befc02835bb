"""Tumbling OHLCV bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AMOUNTS, PRICES, step_seconds


def bucket(ts: str, step: int) -> Column:
    return F.window(ts, f"{step} seconds")["start"]


def resample(bars: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Bars of time frame ``target`` from those of ``source``: left-closed, labelled by their start, buckets without a close dropped."""
    step = step_seconds(target)
    if source == target:
        return bars
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    out = bars.groupBy(*keys, bucket("ts", step).alias("_t")).agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"),
        *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in AMOUNTS if c in bars.columns),
    )
    return out.where(F.col("close").isNotNull()).withColumnRenamed("_t", "ts").select(*keys, "ts", *PRICES, *(c for c in AMOUNTS if c in bars.columns))


def bars_from_ticks(ticks: DataFrame, keys: list[str], step: int, order: list[str]) -> DataFrame:
    """Bars from (keys, ts, price, size): ``order`` is a total order, so first and last are the same on every run."""
    at = F.struct("ts", *order)
    return (
        ticks.groupBy(*keys, F.window("ts", f"{step} seconds").alias("_w"))  # the window itself: on streams it carries the watermark
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("quote_volume"), F.count("*").cast("double").alias("trades"),
        )
        .withColumn("ts", F.col("_w.start"))
        .withColumn("taker_buy_volume", F.lit(0.0))
        .select(*keys, "ts", *PRICES, *AMOUNTS)
    )
