"""Does a strategy look ahead? Its targets on a shortened history must equal those on the whole, bit for bit."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import settled
from ..operators import chunks
from ..operators.chunks import Long
from ..schema import by_time
from .strategies import Strategy, run_segmented


SKIPPED = "look-ahead not checked: the causality harness was switched off"


class CausalityError(ValueError):
    """A strategy whose targets depend on bars after them."""


def cuts(n: int, dense: int = 600, sampled: int = 200) -> list[int]:
    """Lengths at which a series of ``n`` bars is cut: all from 2 up to ``dense`` bars; beyond that one in n // sampled, the quartiles and the last."""
    if n <= dense:
        return list(range(2, n))
    return sorted({*range(2, n, n // sampled), n // 4, n // 2, 3 * n // 4, n - 1})


def cuts_of(n: Column, dense: int = 600, sampled: int = 200) -> Column:
    """cuts() of each series by its own length."""
    last = (n - 1).cast("int")
    every = F.sequence(F.lit(2), F.greatest(last, F.lit(2)))
    marks = F.array(F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int"), last)
    strided = F.sequence(F.lit(2), F.greatest(last, F.lit(2)), F.greatest(F.floor(n / sampled), F.lit(1)).cast("int"))
    some = F.array_sort(F.array_distinct(F.concat(strided, marks)))
    return F.when(n < 3, F.array().cast("array<int>")).when(n <= dense, every).otherwise(some)


def legs_of(strategy: Strategy) -> tuple[str, ...]:
    return ("net", "gross", "carry") if strategy.legs else ("target",)


def compared(strategy: Strategy, bars: DataFrame, keys: list[str], within: list[str] | None = None, long: Long | None = None) -> DataFrame:
    """(keys, ts, cut, n_bars, same): each target on a shortened history beside that on the whole.

    All cuts run as one plan: bars are repeated for each cut that needs them and the cut joins the strategy's partitioning.
    The targets on the whole go with the bars, so the two are compared in a row. A recursive strategy is given whole
    prefixes. One whose target depends on its last ``history`` bars alone is given twice as many, and the later half is compared:
    rows then grow with its memory, not with the series, and a memory that is longer than it says shows as a difference.
    With ``long`` the series and the prefixes are cut into chunks, so no task holds one of them.
    """
    within, legs = within or keys, legs_of(strategy)
    if long:
        bars = settled(chunks.numbered(bars.drop("segment", "gap_start"), keys, long))
        whole = run_segmented(strategy, bars, keys, long)
    else:
        whole = strategy.generate(bars, within)
    whole = whole.select(*bars.columns, *(F.col(c).alias(f"_{c}") for c in legs))
    if long:
        numbered = settled(whole.withColumns({"_row": F.col(chunks.POS) + 1, "_bars": F.col(chunks.LENGTH)}))
    else:
        numbered = whole.withColumns({"_row": F.row_number().over(by_time(keys)), "_bars": F.count("*").over(Window.partitionBy(*keys))})
    # How many bars before a cut are read and compared; a series' first bar is never cut off, as every history begins with it.
    memory = None if strategy.recursive else max(1, int(strategy.history))
    near = (lambda k: F.lit(True)) if memory is None else (lambda k: k < F.col("_row") + 2 * memory)
    at = F.filter(cuts_of(F.col("_bars")), lambda k: (k >= F.col("_row")) & near(k))
    prefixes = numbered.withColumn("_cut", F.explode(at))
    if long and memory is None:
        # A prefix's rows keep their numbers; it is as long as its cut.
        short = run_segmented(strategy, prefixes.withColumn(chunks.LENGTH, F.col("_cut").cast("long")), [*keys, "_cut"], long)
    else:
        short = strategy.generate(prefixes, [*within, "_cut"])
    if memory is not None:
        short = short.where((F.col("_cut") < F.col("_row") + memory) | (F.col("_cut") <= 2 * memory))
    same = F.lit(True)
    for c in legs:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return short.select(*keys, "ts", F.col("_cut").alias("cut"), F.col("_bars").alias("n_bars"), same.alias("same"))


def leaks(strategy: Strategy, bars: DataFrame, keys: list[str], within: list[str] | None = None, long: Long | None = None) -> DataFrame:
    """(keys, cut, first_ts, n_cuts): the cuts at which some target differs, none for a causal strategy."""
    found = compared(strategy, bars, keys, within, long).where("not same").groupBy(*keys, "cut").agg(F.min("ts").alias("first_ts"), F.first("n_bars").alias("_n"))
    return found.select(*keys, "cut", "first_ts", F.size(cuts_of(F.col("_n"))).alias("n_cuts"))


def audit(strategies: Mapping[str, Strategy], bars: DataFrame, keys: list[str], long: Long | None = None) -> DataFrame:
    """(config_id, keys, n_cuts, cut, first_ts, differing): a row for each strategy and series; the last three are null where no cut differs.

    ``strategies`` by config_id; all of them, all series and all cuts are one plan. ``cut`` is the shortest that differs,
    ``first_ts`` the first time that differs under it, ``differing`` how many do.
    """
    series = bars.groupBy(*keys).agg(F.size(cuts_of(F.count("*"))).alias("n_cuts"))
    out = []
    for config_id, strategy in strategies.items():
        worse = compared(strategy, bars, keys, long=long).where("not same").groupBy(*keys, "cut").agg(F.min("ts").alias("first_ts"), F.count("*").alias("differing"))
        first = worse.groupBy(*keys).agg(F.min(F.struct("cut", "first_ts", "differing")).alias("_w"))
        out.append(series.join(first, keys, "left").select(F.lit(config_id).alias("config_id"), *keys, "n_cuts", "_w.*"))
    return reduce(DataFrame.unionByName, out)


def failures(strategies: Mapping[str, Strategy], bars: DataFrame, keys: list[str], long: Long | None = None) -> dict[tuple, str]:
    """Why a strategy of ``strategies`` isn't causal on a series of ``bars``, by (config_id, *keys); nothing for those that are."""
    said: dict[tuple, str] = {}
    for r in audit(strategies, bars, keys, long).where("n_cuts = 0 or cut is not null").collect():  # at most a row for each strategy and series
        what = f"{strategies[r['config_id']].name} on {', '.join(str(r[k]) for k in keys)}: "
        what += "too few bars to tell" if r["cut"] is None else f"not causal: of {r['cut']} bars {r['differing']} get another target than in the whole series, first at {r['first_ts']}"
        said[r["config_id"], *(r[k] for k in keys)] = what
    return said


def looks_ahead(df: DataFrame) -> list[str]:
    """Window frames of a plan that end after the current row, and leads: a static companion to leaks(), blind to opaque UDFs."""
    plan = df._jdf.queryExecution().analyzed().toString()
    ahead = re.findall(r"lead\([^)]*\)", plan)
    frames = re.findall(r"specifiedwindowframe\((?:RowFrame|RangeFrame), [^,]+, ([^)]+)\)", plan)
    after = lambda f: "unboundedfollowing" in f.lower() or re.fullmatch(r"[1-9]\d*", f.strip()) is not None
    return [*ahead, *(f"frame up to {f}" for f in frames if after(f))]
