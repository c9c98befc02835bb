"""Rolling features as window expressions. ``within`` is the partition: series keys and, inside strategies, the segment."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import by_time, finite, last_rows, ratio

TINY = 1e-12


def _full(x: Column, value: Column, frame, n: int) -> Column:
    return F.when(F.count(x).over(frame) == n, value)


def rolling_mean(x: Column, within: list[str], n: int) -> Column:
    frame = last_rows(by_time(within), n)
    return _full(x, F.avg(x).over(frame), frame, n)


def rolling_sigma(x: Column, within: list[str], n: int) -> Column:
    """Standard deviation of the last ``n`` values, divisor n; null until there are as many."""
    frame = last_rows(by_time(within), n)
    return _full(x, F.stddev_pop(x).over(frame), frame, n)


def zscore(x: Column, within: list[str], n: int) -> Column:
    """Never null: 0 while the window fills and where nothing moves."""
    sigma = rolling_sigma(x, within, n)
    return F.coalesce(F.when(sigma > TINY, (x - rolling_mean(x, within, n)) / sigma), F.lit(0.0))


def true_range(within: list[str]) -> Column:
    before = F.lag("close").over(by_time(within))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def directional_moves(within: list[str]) -> tuple[Column, Column]:
    """Upward and downward directional movement, null on the first bar."""
    w = by_time(within)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    zero = F.when(up.isNotNull() & down.isNotNull(), 0.0)
    return F.when((up > down) & (up > 0), up).otherwise(zero), F.when((down > up) & (down > 0), down).otherwise(zero)


def sigma_zscore(x: Column, within: list[str], n: int) -> Column:
    """As zscore(), but null, not 0, where it can't be told."""
    sigma = rolling_sigma(x, within, n)
    return F.when(sigma > TINY, (x - rolling_mean(x, within, n)) / sigma)


def regime(z: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """-1 quiet, 0 usual, 1 wild; bounds included, null where z is."""
    return F.when(z.isNull(), None).when(z <= low, -1.0).when(z >= high, 1.0).otherwise(0.0)


def funding_mean(within: list[str], n: int) -> Column:
    """Mean of the last rates, of as many as there are."""
    return F.avg("funding_rate").over(last_rows(by_time(within), n))


def funding_zscore(within: list[str], n: int) -> Column:
    return zscore(F.col("funding_rate"), within, n)


def rolling_quantile(x: Column, within: list[str], n: int, q: float) -> Column:
    """Exact quantile with linear interpolation over the last ``n`` values; null until there are as many."""
    frame = last_rows(by_time(within), n)
    return _full(x, F.percentile(x, F.lit(q)).over(frame), frame, n)


def squeeze(x: Column, bars: DataFrame, within: list[str], n: int, mean_of: int, share: float) -> DataFrame:
    """``bars`` with squeezed: sigma below ``share`` of its own rolling mean; false while either fills."""
    wide = bars.withColumn("_sigma", rolling_sigma(x, within, n))
    calm = F.col("_sigma") < rolling_mean(F.col("_sigma"), within, mean_of) * share
    return wide.withColumn("squeezed", F.coalesce(calm, F.lit(False))).drop("_sigma")


def _steps(within: list[str], x: str) -> tuple[Column, Column]:
    before = F.lag(x).over(by_time(within))
    return F.col(x) - before, before


def ou_regression(bars: DataFrame, keys: list[str], x: str = "close") -> DataFrame:
    """Least squares of a series' steps on its levels: (keys, n, theta, mu, sigma, half_life, r2) of a mean-reverting process."""
    step, before = _steps(keys, x)
    pairs = bars.withColumns({"_x": before, "_y": step})
    ok = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    fit = pairs.groupBy(*keys).agg(
        F.count(x).alias("n"), F.count_if(ok).alias("m"), F.avg(F.when(ok, F.col("_x"))).alias("mx"), F.avg(F.when(ok, F.col("_y"))).alias("my"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_sxy("_y", "_x").alias("sxy"), F.regr_syy("_y", "_x").alias("syy"),
    )
    b = ratio(F.col("sxy"), F.col("sxx"))
    a = F.col("my") - b * F.col("mx")
    rss = F.greatest(F.col("syy") - b * F.col("sxy"), F.lit(0.0))
    enough, flat = F.col("n") >= 10, F.col("sxx") < TINY
    theta = -b
    return fit.select(
        *keys, "n",
        F.when(enough & ~flat, theta).alias("theta"),
        F.when(enough, F.when(flat | ~(theta > 0), F.col("mx")).otherwise(-a / b)).alias("mu"),
        F.when(enough, F.when(flat, 0.0).otherwise(F.sqrt(rss / (F.col("m") - 2)))).alias("sigma"),
        F.when(enough & ~flat & (theta > 0), math.log(2) / theta).alias("half_life"),
        F.when(enough & ~flat, F.when(F.col("syy") > TINY, 1 - rss / F.col("syy")).otherwise(0.0)).alias("r2"),
    )


def rolling_half_life(within: list[str], n: int, x: str = "_level", step: str = "_step") -> Column:
    """Half-life over the ``n`` values before a bar, itself left out: they hold n - 1 steps. Needs columns of levels and steps."""
    frame = by_time(within).rowsBetween(1 - n, -1)
    slope = F.when(F.regr_sxx(step, x).over(frame) >= TINY, F.regr_slope(step, x).over(frame))
    full = F.count(step).over(frame) == n - 1
    return F.when(full & (slope < 0), math.log(2) / -slope)


def half_life_ok(bars: DataFrame, within: list[str], n: int, least: float, most: float) -> DataFrame:
    """``bars`` with hl_ok: the half-life lies within bounds; false for the first ``n`` bars of a partition."""
    step, before = _steps(within, "close")
    wide = bars.withColumns({"_step": step, "_level": before, "_nth": F.row_number().over(by_time(within))})
    fits = (F.col("_nth") > n) & rolling_half_life(within, n).between(least, most)
    return wide.withColumn("hl_ok", F.coalesce(fits, F.lit(False))).drop("_step", "_level", "_nth")


def atr_memory(length: int, tolerance: float = 1e-3) -> int:
    """Bars after which an old true range weighs less than ``tolerance`` in the smoothed one."""
    return 1 if length <= 1 else math.ceil(math.log(tolerance) / math.log(1 - 1 / length))


def adx_memory(length: int, tolerance: float = 1e-3) -> int:
    """The same for two smoothings in turn, whose weight after m bars, (1 + m / L) (1 - 1 / L) ** m, only ever falls."""
    if length <= 1:
        return 1
    weight = lambda m: (1 + m / length) * (1 - 1 / length) ** m
    beyond = next(2**k for k in itertools.count() if weight(2**k) <= tolerance)
    return bisect_left(range(beyond), True, lo=1, key=lambda m: weight(m) <= tolerance)


def clean_number(x: str) -> Column:
    return finite(F.col(x).cast("double"))
