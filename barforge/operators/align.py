"""Alignment of events and series with bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import by_time
from .resample import bucket


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def series_width(bars: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, _step): the median positive interval between bars of each series in microseconds, without ordering a series as a whole.

    Intervals inside a stretch of ``span`` microseconds come from its own window, those between stretches from a row for each stretch.
    """
    rows = bars.select(*keys, _micros(F.col("ts")).alias("_m")).withColumn("_t", F.floor(F.col("_m") / span))
    inside = rows.select(*keys, (F.col("_m") - F.lag("_m").over(Window.partitionBy(*keys, "_t").orderBy("_m"))).alias("_g"))
    ends = rows.groupBy(*keys, "_t").agg(F.min("_m").alias("_a"), F.max("_m").alias("_z"))
    across = ends.select(*keys, (F.col("_a") - F.lag("_z").over(Window.partitionBy(*keys).orderBy("_t"))).alias("_g"))
    counted = inside.unionByName(across).where(F.col("_g") > 0).groupBy(*keys, "_g").agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.percentile("_g", F.lit(0.5), F.col("_n")).alias("_step"))


def containing_bar(bars: DataFrame, events: DataFrame, keys: list[str], step: int | None, event_keys: list[str] | None = None, rows: int = 10_000) -> DataFrame:
    """Events with ``bar_ts``, the last bar at or before them, where they lie inside that bar; the others are dropped.

    Time is cut into buckets of ``rows`` bars' length. Bars and events of a series and bucket are one sorted sequence, which
    begins with the series' last bar of the bucket before: no bar reaches further, as none is longer than a bucket. So a hot
    series is many tasks, each event is read once for each series that has bars near it, and no range is joined. Without ``step``
    the median interval of a series is its bars' length. Events without the series' keys meet a series by bucket.
    """
    on = keys if event_keys is None else event_keys
    if step is None:
        width = series_width(bars, keys, 86_400_000_000 * 30)
        longest = width.agg(F.max("_step")).first()[0] or 1.0
    else:
        width, longest = None, step * 1e6
    bucket_of = lambda c: F.floor(_micros(c) / (float(longest) * rows))
    b = bars.select(*keys, "ts", bucket_of(F.col("ts")).alias("_t"))
    before = b.groupBy(*keys, "_t").agg(F.max("ts").alias("ts")).select(*keys, "ts", (F.col("_t") + 1).alias("_t"))
    b = b.unionByName(before)
    e = events.select(*on, F.col("ts").alias("_at"), F.col("rate"), bucket_of(F.col("ts")).alias("_t"))
    if set(on) != set(keys):
        e = e.join(b.select(*keys, "_t").distinct(), [*on, "_t"])
    marked = b.select(*keys, "_t", "ts", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("rate"))
    both = marked.unionByName(e.select(*keys, "_t", F.col("_at").alias("ts"), F.lit(1).alias("_kind"), F.col("rate").cast("double").alias("rate")))
    at = Window.partitionBy(*keys, "_t").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("bar_ts", F.last(F.when(F.col("_kind") == 0, F.col("ts")), ignorenulls=True).over(at)).where(F.col("_kind") == 1)
    if width is None:
        both = both.withColumn("_step", F.lit(longest))
    else:
        both = both.join(width, keys, "left").withColumn("_step", F.coalesce("_step", F.lit(1.0)))  # a lone bar holds its own instant
    inside = _micros(F.col("ts")) < _micros(F.col("bar_ts")) + F.col("_step")
    return both.where(inside).select(*keys, "ts", "rate", "bar_ts")


def attach_funding(bars: DataFrame, funding: DataFrame, keys: list[str], step: int | None, on_grid: bool = False, event_keys: list[str] | None = None) -> DataFrame:
    """``bars`` with funding_rate: the sum of the rates of the events inside each bar, 0 where there are none.

    ``on_grid``: all bars begin at multiples of ``step``, so an event's bar is found by arithmetic and joined by equality.
    """
    on = keys if event_keys is None else event_keys
    if on_grid and step:
        sums = funding.groupBy(*on, bucket("ts", step).alias("_t")).agg(F.sum("rate").alias("_r"))
        joined = bars.join(sums.select(*(F.col(k).alias(f"_{k}") for k in on), "_t", "_r"), [F.col(k) == F.col(f"_{k}") for k in on] + [F.col("ts") == F.col("_t")], "left")
        return joined.withColumn("funding_rate", F.coalesce("_r", F.lit(0.0))).drop("_t", "_r", *(f"_{k}" for k in on))
    sums = containing_bar(bars, funding, keys, step, event_keys).groupBy(*keys, F.col("bar_ts").alias("ts")).agg(F.sum("rate").alias("_r"))
    return bars.join(sums, [*keys, "ts"], "left").withColumn("funding_rate", F.coalesce("_r", F.lit(0.0))).drop("_r")


def matched_events(bars: DataFrame, funding: DataFrame, keys: list[str], step: int | None, event_keys: list[str] | None = None) -> DataFrame:
    """(keys, matched): events inside a bar, those with rate 0 among them; series without any have 0."""
    found = containing_bar(bars, funding, keys, step, event_keys).groupBy(*keys).agg(F.count("*").alias("_m"))
    return bars.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("_m", F.lit(0)).alias("matched"))


def check_returns_matrix(returns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Faults of a long returns matrix (config_id, ts, ret), one for each of ``keys``, as rows (keys, fault, config_id); none when it is usable.

    Checked: two configurations or more, equal times, finite values, no two equal columns. Times and columns are compared by
    two independent hashes of their rows, so no pair of configurations is compared as such.
    """
    keys = keys or []
    total = lambda *c: F.struct(*(F.sum(F.xxhash64(F.lit(s), *c).cast("decimal(38,0)")) for s in (1, 2)))
    each = returns.groupBy(*keys, "config_id").agg(
        F.count("*").alias("n"),
        total("ts").alias("times"),
        F.count_if(F.col("ret").isNull() | F.isnan("ret") | (F.abs("ret") == float("inf"))).alias("bad"),
        total("ts", "ret").alias("content"),
    )
    matrix = Window.partitionBy(*keys)
    alike = each.withColumn("_same", F.count("*").over(Window.partitionBy(*keys, "n", "times")))
    usual = F.max(F.struct("_same", "n", "times")).over(matrix)
    marked = alike.withColumns({"_usual": usual, "_twins": F.count("*").over(Window.partitionBy(*keys, "content")), "_all": F.count("*").over(matrix)})
    faults = (
        ("other times", (F.col("n") != F.col("_usual.n")) | (F.col("times") != F.col("_usual.times"))), ("value not finite", F.col("bad") > 0),
        ("equal to another", F.col("_twins") > 1), ("fewer than two configurations", F.col("_all") < 2),
    )
    found = F.array_compact(F.array(*(F.when(wrong, F.lit(what)) for what, wrong in faults)))
    return marked.select(*keys, F.explode(found).alias("fault"), "config_id")


def union_of_times(series: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(ts, n_series, values): at each time that any series has, the mean over all series, null where one has no row or value."""
    everyone = series.agg(F.countDistinct(key).alias("_all"))
    mean = lambda c: F.when(F.count(c) == F.max("_all"), F.avg(c)).alias(c)
    return series.join(F.broadcast(everyone), F.lit(True)).groupBy("ts").agg(F.count("*").alias("n_series"), *map(mean, values))  # a single row
