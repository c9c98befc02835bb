"""Bar quality, gaps and gap-free segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import PRICES, by_time
from . import chunks
from .chunks import Long


def no_volume() -> Column:
    return F.coalesce(F.col("volume") <= 0, F.lit(True))


def bad_prices() -> Column:
    o, h, l, c = map(F.col, PRICES)
    broken = (h < l) | (h < F.greatest(o, c)) | (l > F.least(o, c)) | (F.least(o, h, l, c) <= 0)
    return F.coalesce(broken, F.lit(True)) | F.concat_ws("", *(F.col(p).isNull().cast("string") for p in PRICES)).contains("true")


def dirty() -> Column:
    """One predicate for the mask and for the report."""
    return no_volume() | bad_prices()


def clean() -> Column:
    return ~dirty()


def interval(keys: list[str]) -> Column:
    """Seconds since the bar before; null for the first."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return seconds(F.col("ts")) - seconds(F.lag("ts").over(by_time(keys)))


def with_gaps(bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """``bars`` with gap_start: the interval before this bar is strictly longer than ``step`` seconds."""
    return bars.withColumn("gap_start", F.coalesce(interval(keys) > step, F.lit(False)))


def with_segments(bars: DataFrame, keys: list[str], step: int, long: Long | None = None) -> DataFrame:
    """``bars`` with gap_start and segment, the number of the gap-free run. With ``long`` the series are cut, numbered, and stay so."""
    if long:
        rows = chunks.numbered(bars, keys, long)
        marked = chunks.apply_with_halo(rows, keys, long, 1, lambda d, within: with_gaps(d, within, step))
        return chunks.running(marked, keys, long, sums={"segment": F.col("gap_start").cast("int")}).withColumn("segment", F.col("segment").cast("int"))
    upto = by_time(keys).rowsBetween(Window.unboundedPreceding, 0)
    return with_gaps(bars, keys, step).withColumn("segment", F.sum(F.col("gap_start").cast("int")).over(upto).cast("int"))


def gap_statistics(bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, gaps, missing_bars): how many holes, and how many bars they hold."""
    wide = bars.withColumn("_w", interval(keys))
    long = F.col("_w") > step
    missing = F.round(F.coalesce(F.sum(F.when(long, F.col("_w") - step)), F.lit(0.0)) / step)
    return wide.groupBy(*keys).agg(F.count_if(long).alias("gaps"), missing.cast("long").alias("missing_bars"))


def gap_mask(keys: list[str], lookback: int = 1, lookahead: int = 0) -> Column:
    """True near a hole: for a gap before bar i, the bars i - lookback to i + lookahead - 1. Needs gap_start.

    It looks ahead on purpose: a finished series is masked after targets are made, outside any strategy.
    """
    near = by_time(keys).rowsBetween(1 - lookahead, lookback)
    return F.coalesce(F.max("gap_start").over(near), F.lit(False))


def with_tradable(bars: DataFrame, keys: list[str], lookback: int = 1, lookahead: int = 0, long: Long | None = None) -> DataFrame:
    if long:
        marked = lambda d, within: d.withColumn("tradable", clean() & ~gap_mask([*keys, chunks.CHUNK], lookback, lookahead))  # noqa: E731  across segments
        return chunks.apply_with_halo(chunks.numbered(bars, keys, long), keys, long, max(lookahead - 1, 0), marked, after=max(lookback, 0))
    return bars.withColumn("tradable", clean() & ~gap_mask(keys, lookback, lookahead))


def quality_report(bars: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, total, gaps, duplicates, zero_volume, anomalous, bad_rows) in one aggregation over distinct times and one window."""
    gaps = with_gaps(bars, keys, step)
    out = gaps.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("gap_start").alias("gaps"),
        (F.count("*") - F.countDistinct("ts")).alias("duplicates"),
        F.count_if(no_volume()).alias("zero_volume"),
        F.count_if(bad_prices()).alias("anomalous"),
    )
    return out.withColumn("bad_rows", F.col("zero_volume") + F.col("anomalous"))
