"""Equal-weight portfolios of sleeves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.align import union_of_times


def sleeve_notional(leverage: float) -> float:
    """Share of capital in one leg when the other needs margin 1 / leverage."""
    if not 0 < leverage < float("inf"):
        raise ValueError("leverage must be positive and finite")
    return 1 / (1 + 1 / leverage)


def equal_weight(book: DataFrame, key: str) -> DataFrame:
    """The ledger of the mean of all sleeves (one for each ``key``) over the union of their times.

    A time at which a sleeve has no bar has a null mean. in_book counts sleeves with a position, cap_hits adds theirs.
    The portfolio is one series: its curve runs in one ordered window over one row for each time.
    """
    parts = ["returns", "fee", "slippage", "funding", "gross_held", "turnover", "price_return", "held", "gross_return"]
    means = union_of_times(book.select(key, "ts", *parts), key, parts)
    counts = book.groupBy("ts").agg(
        F.count_if(F.col("gross_held") > 0).alias("in_book"), F.count_if("cap_hit").alias("cap_hits"), F.max("participation").alias("participation")
    )
    rows = means.join(counts, "ts").withColumn("portfolio", F.lit("all"))
    upto = Window.partitionBy("portfolio").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", F.when(F.col("returns").isNotNull(), F.product(1 + F.col("returns")).over(upto)))
    return rows.withColumn("drawdown", F.col("equity") / F.max("equity").over(upto) - 1)


def sleeve_faults(book: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """(keys, fault, bars): broken invariants of fixed-notional carry sleeves (with net, gross, carry); none when all hold."""
    near = lambda a, b: F.abs(a - b) <= 1e-15 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    on, rate = F.col("gross_held") > 0, F.coalesce("funding_rate", F.lit(0.0))
    rules = {
        "net position": F.col("held") == 0,
        "carry": F.col("carry").isin(0.0, -weight),
        "gross follows carry": near(F.col("gross"), F.when(F.col("carry") != 0, 2 * weight).otherwise(0.0)),
        "held gross": F.col("gross_held").isin(0.0, 2 * weight),
        "turnover": (F.col("turnover") == 0) | near(F.col("turnover"), F.lit(2 * weight)),
        "funding": F.when(on, near(F.col("funding"), -weight * rate)).otherwise(F.col("funding") == 0),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("fault"), (~v).alias("broken")) for k, v in rules.items()))).alias("e")
    return book.select(*keys, each).where("e.broken").groupBy(*keys, "e.fault").agg(F.count("*").alias("bars"))
