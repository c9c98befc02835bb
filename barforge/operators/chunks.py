"""Series longer than a task: rows are numbered, cut into chunks, and windows and running values are put together from them.

A window over ``partitionBy(symbol)`` is one task for a symbol's whole history. Here a series is first numbered by a
two-level scan (rows inside stretches of time, stretches inside the series), which needs no task with more rows than a
stretch. By number it is then cut into chunks of equal size. A rolling window reads a chunk and the rows just before it, its
halo; a running value is folded in every chunk, the folds are scanned, and each chunk takes up what came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import settled

#: Columns that numbered() adds: a row's number in its series, from 0, and the length of the series.
POS, LENGTH = "_pos", "_len"
#: The column by which apply_with_halo() and running() partition, beside the series' keys.
CHUNK = "_chunk"


@dataclass(frozen=True)
class Long:
    """How series are cut: chunks of ``rows`` bars; ``step`` is the shortest time between two bars in seconds."""

    rows: int
    step: int

    def __post_init__(self):
        if self.rows < 1 or self.step < 1:
            raise ValueError("rows and step must be 1 or more")


def numbered(df: DataFrame, keys: list[str], long: Long, order: str = "ts") -> DataFrame:
    """``df`` with POS and LENGTH, unless it has them already."""
    if POS in df.columns:
        return df
    stretch = F.floor(F.unix_micros(F.col(order).cast("timestamp")) / F.lit(long.rows * long.step * 1_000_000))
    rows = settled(df.withColumn("_t", stretch))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(order)))
    counts = rows.groupBy(*keys, "_t").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_t", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias(LENGTH))
    return inside.join(counts, [*keys, "_t"]).withColumn(POS, F.col("_before") + F.col("_i") - 1).select(*df.columns, POS, LENGTH)


def bare(df: DataFrame) -> DataFrame:
    """``df`` without the columns of numbered()."""
    return df.drop(POS, LENGTH)


def apply_with_halo(df: DataFrame, keys: list[str], long: Long, before: int, apply: Callable[[DataFrame, list[str]], DataFrame], after: int = 0) -> DataFrame:
    """What ``apply(rows, within)`` gives for each row of the numbered ``df``, where it needs ``before`` rows before and ``after`` rows after.

    ``apply`` gets chunks with their halo and partitions by ``within``: the keys, a segment if there is one, and the chunk. No
    partition has more than long.rows + before + after rows; rows of a halo that lie in another segment are in another partition.
    """
    last = (F.col(LENGTH) - 1) / long.rows
    first_chunk = F.floor(F.greatest(F.col(POS) - after, F.lit(0)) / long.rows)
    last_chunk = F.least(F.floor((F.col(POS) + before) / long.rows), F.floor(last))
    rows = df.withColumn(CHUNK, F.explode(F.sequence(first_chunk, last_chunk)))
    within = [*keys, *(["segment"] if "segment" in df.columns else []), CHUNK]
    return apply(rows, within).where(F.col(CHUNK) == F.floor(F.col(POS) / long.rows)).drop(CHUNK)


def running(
    df: DataFrame, keys: list[str], long: Long, sums: Mapping[str, Column] | None = None, products: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``df``, numbered, with running sums, products and greatest values from a series' first row to the row itself; null values count for nothing."""
    kinds = [
        (sums or {}, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
        (products or {}, F.product, lambda a, b: F.coalesce(a * b, a, b)),
        (maxima or {}, F.max, F.greatest),
    ]
    rows = settled(df.withColumn(CHUNK, F.floor(F.col(POS) / long.rows)).repartition(*keys, CHUNK))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    local, folds, carries, done = {}, [], [], {}
    for values, fold, both in kinds:
        for name, value in values.items():
            local[f"_in_{name}"] = fold(value).over(inside)
            folds.append(fold(value).alias(f"_all_{name}"))
            carries.append(fold(f"_all_{name}").over(earlier).alias(f"_was_{name}"))
            done[name] = both(F.col(f"_was_{name}"), F.col(f"_in_{name}"))
    carry = rows.groupBy(*keys, CHUNK).agg(*folds).select(*keys, CHUNK, *carries)
    joined = rows.withColumns(local).join(carry, [*keys, CHUNK])
    kept = [c for c in df.columns if c not in done]
    return joined.select(*kept, *(v.alias(n) for n, v in done.items()))
