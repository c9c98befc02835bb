"""Path-dependent series that are longer than a task: smoothing as composed affine maps, bracket exits as chained walks.

Both begin from what chunks.py gives: numbered series cut into chunks. What a chunk does to any state that may reach it is
told by a small summary; the summaries of a series are chained in order, and every chunk then starts from the state it gets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import settled
from ..schema import by_time, finite, last_rows
from . import chunks, features
from .chunks import CHUNK, LENGTH, POS, Long
from .kernels import trade_end


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in names]


def smoothed(df: DataFrame, keys: list[str], columns: Mapping[str, str], length: int, long: Long) -> DataFrame:
    """``df``, numbered, with Wilder's smoothing of each source in ``columns`` (result to source), as kernels.wilder gives it for each segment.

    Each row maps the smoothed value before it to its own: none where a run of known values is too short, the mean of the run's
    first ``length`` values where it becomes long enough, and s + (x - s) / length after that. These maps are affine, (a, b)
    with a = 0 at a reset, and so are their compositions: a chunk's is one pair, and a segment or hole inside it is no exception.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")
    sources, segment = dict(columns), ["segment"] if "segment" in df.columns else []
    own, value = df.columns, lambda c: finite(F.col(c).cast("double"))

    def breaks(d: DataFrame, within: list[str]) -> DataFrame:
        """Where each source's run is broken: the row before a segment's first, or a row without a value."""
        at = by_time([*keys, CHUNK])
        first = F.lit(False) if not segment else ~F.col("segment").eqNullSafe(F.lag("segment").over(at))
        start = F.when((F.col(POS) == 0) | first, F.col(POS) - 1)
        return d.withColumns({f"_b_{n}": F.when(value(c).isNull(), F.col(POS)).otherwise(start) for n, c in sources.items()})

    rows = chunks.apply_with_halo(df, keys, long, 1, breaks)
    rows = chunks.running(rows, keys, long, maxima={f"_l_{n}": F.col(f"_b_{n}") for n in sources}).drop(*(f"_b_{n}" for n in sources))

    def means(d: DataFrame, within: list[str]) -> DataFrame:
        frame = last_rows(by_time([*keys, CHUNK]), length)
        nth = lambda n: F.col(POS) - F.col(f"_l_{n}")  # noqa: E731  of its run, from 1
        seed = lambda n, c: F.when(nth(n) == length, F.avg(value(c)).over(frame))
        return d.withColumns({f"_s_{n}": seed(n, c) for n, c in sources.items()} | {f"_x_{n}": F.when(nth(n) > length, value(c)) for n, c in sources.items()})

    rows = chunks.apply_with_halo(rows, keys, long, length - 1, means).withColumn(CHUNK, F.floor(F.col(POS) / long.rows)).drop(*(f"_l_{n}" for n in sources))

    # Inside a chunk: from nothing known before it, b; and how much of a value before it is left, a.
    maps = [f"_{kind}_{n}" for n in sources for kind in "ab"]
    schema = T.StructType([*_fields(rows, own), *_fields(rows, [CHUNK]), *(T.StructField(m, T.DoubleType()) for m in maps)])

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(POS, kind="stable")
        out = part[[*own, CHUNK]].copy()
        for n in sources:
            a, b = affine_path(part[f"_s_{n}"].to_numpy(dtype="float64"), part[f"_x_{n}"].to_numpy(dtype="float64"), length)
            out[f"_a_{n}"], out[f"_b_{n}"] = a, b
        return out

    local = settled(rows.groupBy(*keys, CHUNK).applyInPandas(walk, schema))
    ends = local.groupBy(*keys, CHUNK).agg(*(F.max_by(m, POS).alias(m) for m in maps))
    carried = [f"_c_{n}" for n in sources]
    to = T.StructType([*_fields(ends, keys), *_fields(ends, [CHUNK]), *(T.StructField(c, T.DoubleType()) for c in carried)])

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(CHUNK)
        out = part[[*keys, CHUNK]].copy()
        for n in sources:
            state, states = np.nan, []
            for a, b in zip(part[f"_a_{n}"], part[f"_b_{n}"], strict=True):
                states.append(state)
                state = (a * state if a else 0.0) + b
            out[f"_c_{n}"] = states
        return out

    carry = ends.groupBy(*keys).applyInPandas(chain, to)  # a row for each chunk, not for each bar
    joined = local.join(carry, [*keys, CHUNK])
    known = lambda n: F.when(F.col(f"_a_{n}") != 0, F.col(f"_a_{n}") * F.col(f"_c_{n}") + F.col(f"_b_{n}")).otherwise(F.col(f"_b_{n}"))
    return joined.select(*(c for c in own if c not in sources), *(finite(known(n)).alias(n) for n in sources))


def affine_path(seeds: np.ndarray, values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the map (a, b) from the state before the first row to its own. ``seeds``: the state where it begins anew;
    ``values``: what is smoothed in; where both are missing there is no state."""
    keep, a, b = 1 - 1 / length, 1.0, 0.0
    out_a, out_b = np.empty(len(seeds)), np.empty(len(seeds))
    for i, (seed, x) in enumerate(zip(seeds.tolist(), values.tolist(), strict=True)):
        if seed == seed:
            a, b = 0.0, seed
        elif x == x:
            a, b = a * keep, b + (x - b) / length if a == 0 else b * keep + x / length
        else:
            a, b = 0.0, float("nan")
        out_a[i], out_b[i] = a, b
    return out_a, out_b


def ranges(df: DataFrame, keys: list[str], long: Long, atr_length: int, adx_length: int | None = None) -> DataFrame:
    """``df`` (high, low, close), numbered, with atr and, when asked for, adx: kernels.with_ranges for long series. Null, not NaN, where there is none."""
    own = df.columns

    def moves(d: DataFrame, within: list[str]) -> DataFrame:
        up, down = features.directional_moves(within)
        return d.withColumns({"_tr": features.true_range(within), "_up": up, "_down": down})

    wide = chunks.apply_with_halo(df, keys, long, 1, moves)
    if not adx_length:
        return smoothed(wide, keys, {"atr": "_tr"}, atr_length, long).select(*own, "atr")
    together = {"_span": "_tr", "_plus": "_up", "_minus": "_down"}
    if atr_length == adx_length:
        wide = smoothed(wide, keys, together, adx_length, long).withColumn("atr", F.col("_span"))
    else:
        wide = smoothed(smoothed(wide, keys, {"atr": "_tr"}, atr_length, long), keys, together, adx_length, long)
    share = lambda c: F.when(F.col("_span") > 0, 100 * F.col(c) / F.col("_span"))
    total = share("_plus") + share("_minus")
    wide = wide.withColumn("_dx", 100 * F.abs(share("_plus") - share("_minus")) / F.when(total == 0, 1.0).otherwise(total))
    return smoothed(wide, keys, {"adx": "_dx"}, adx_length, long).select(*own, "atr", "adx")


def _segment_ends(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with _end, the number of the first row after a row's segment."""
    if "segment" not in df.columns:
        return df.withColumn("_end", F.col(LENGTH))
    ends = df.groupBy(*keys, "segment").agg((F.max(POS) + 1).alias("_end"))
    return df.join(ends, [*keys, "segment"])


def brackets(df: DataFrame, keys: list[str], max_bars: int, long: Long) -> DataFrame:
    """``df`` (high, low, entry, stop_price, take_price), numbered, with target: kernels.with_brackets for long series, to the bit.

    How a trade ends depends on its entry alone, so every signal's end is found from its chunk and the ``max_bars`` rows after
    it, taken or not. A signal is taken if no earlier trade is still open, so what reaches a chunk is one number, the first bar
    that may open a trade; what leaves it is a step function of that number, with one step where all walks have met. The steps
    of a series are chained in order; then each chunk picks the signals that are taken.
    """
    own = df.columns
    signal = F.coalesce(F.col("entry"), F.lit(0.0))
    checked = F.when(signal.isin(-1.0, 0.0, 1.0), signal).otherwise(F.raise_error(F.lit("entries must be -1, 0 or 1")).cast("double"))
    rows = settled(_segment_ends(settled(df.withColumn("_side", checked)), keys))
    near = rows.select(*keys, *(["segment"] if "segment" in own else []), POS, LENGTH, "_end", "_side", "high", "low", "stop_price", "take_price")
    # A chunk and the rows after it: the halo of rows that lie before a later chunk.
    reach = near.withColumn(CHUNK, F.explode(F.sequence(F.floor(F.greatest(F.col(POS) - max_bars, F.lit(0)) / long.rows), F.floor(F.col(POS) / long.rows))))
    trades = T.StructType([*_fields(near, keys), T.StructField(CHUNK, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("_at", "_leave", "_free")), T.StructField("_side", T.DoubleType())])

    def outcomes(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(POS, kind="stable")
        pos, side, end = (part[c].to_numpy() for c in (POS, "_side", "_end"))
        high, low, stop, take = (part[c].to_numpy(dtype="float64") for c in ("high", "low", "stop_price", "take_price"))
        found = []
        for i in np.flatnonzero((side != 0) & (pos // long.rows == part[CHUNK].iloc[0])):
            until = i + int(min(end[i] - pos[i], max_bars + 1))
            leave = int(pos[i]) + trade_end(side[i], high[i:until], low[i:until], stop[i], take[i], max_bars)
            found.append([*(part[k].iloc[0] for k in keys), int(part[CHUNK].iloc[0]), int(pos[i]), leave, int(min(leave + 1, end[i])), float(side[i])])
        return pd.DataFrame(found, columns=[f.name for f in trades.fields])

    ends = settled(reach.groupBy(*keys, CHUNK).applyInPandas(outcomes, trades))
    steps = T.StructType([*_fields(near, keys), T.StructField(CHUNK, T.LongType()), T.StructField("_upto", T.LongType()), T.StructField("_out", T.LongType())])

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        upto, out = walk_steps(part["_at"].to_numpy(), part["_free"].to_numpy(), (int(part[CHUNK].iloc[0]) + 1) * long.rows)
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, CHUNK: part[CHUNK].iloc[0], "_upto": upto, "_out": out})[[f.name for f in steps.fields]]

    to = T.StructType([*_fields(near, keys), T.StructField(CHUNK, T.LongType()), T.StructField("_open", T.LongType())])

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part, free, found = part.sort_values([CHUNK, "_upto"]), 0, []
        for chunk, own_steps in part.groupby(CHUNK, sort=True):
            found.append([*(part[k].iloc[0] for k in keys), int(chunk), free])
            k = int(np.searchsorted(own_steps["_upto"].to_numpy(), free))
            free = int(own_steps["_out"].iloc[k]) if k < len(own_steps) else free
        return pd.DataFrame(found, columns=[f.name for f in to.fields])

    opened = ends.groupBy(*keys, CHUNK).applyInPandas(summary, steps).groupBy(*keys).applyInPandas(chain, to)
    taken = T.StructType([*_fields(near, keys), T.StructField(POS, T.LongType()), T.StructField("_leave", T.LongType()), T.StructField("_side", T.DoubleType())])

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part, free, kept = part.sort_values("_at"), int(part["_open"].iloc[0]), []
        for i, (at, after) in enumerate(zip(part["_at"].tolist(), part["_free"].tolist(), strict=True)):
            if at >= free:
                kept.append(i)
                free = after
        return part.iloc[kept].rename(columns={"_at": POS})[[f.name for f in taken.fields]]

    entries = ends.join(opened, [*keys, CHUNK]).groupBy(*keys, CHUNK).applyInPandas(pick, taken)
    marked = rows.select(*own).join(entries.select(*keys, POS, F.struct(F.col(POS).alias("at"), "_leave", "_side").alias("_trade")), [*keys, POS], "left")
    held = chunks.running(marked, keys, long, maxima={"_trade": F.col("_trade")})  # the last trade begun
    return held.withColumn("target", F.when(F.col(POS) < F.col("_trade._leave"), F.col("_trade._side")).otherwise(0.0)).select(*own, "target")


def walk_steps(at: np.ndarray, free: np.ndarray, stop: int) -> tuple[list[int], list[int]]:
    """What a chunk's signals make of the first bar that may open a trade: up to ``upto[i]`` (and above ``upto[i - 1]``) it becomes ``out[i]``.

    ``at``: bars with signals in order; ``free``: the first bar after each one's trade; ``stop``: the first bar after the chunk. Above the last
    step it stays what it is. From the last signal backwards, each signal leads to where the next signal after its trade leads.
    """
    n = len(at)
    follows = np.searchsorted(at, free)
    out = [0] * n
    for i in range(n - 1, -1, -1):
        out[i] = out[follows[i]] if follows[i] < n else int(free[i])
    # Equal results of neighbouring signals are one step: all walks have met there.
    last = [i for i in range(n) if i == n - 1 or out[i] != out[i + 1]]
    return [int(at[i]) for i in last], [out[i] for i in last]


class Sliding:
    """The values of a sliding window in order, in blocks of bounded size: adding, removing and the k-th smallest touch one block each."""

    def __init__(self, block: int):
        self.block, self.parts, self.size = block, [[]], 0

    def _part(self, x: float) -> int:
        low, high = 0, len(self.parts) - 1
        while low < high:
            mid = (low + high) // 2
            if self.parts[mid] and self.parts[mid][-1] >= x:
                high = mid
            else:
                low = mid + 1
        return low

    def add(self, x: float) -> None:
        k = self._part(x)
        part = self.parts[k]
        part.insert(bisect_left(part, x), x)
        self.size += 1
        if len(part) > self.block:
            half = len(part) // 2
            self.parts[k : k + 1] = [part[:half], part[half:]]

    def remove(self, x: float) -> None:
        k = self._part(x)
        part = self.parts[k]
        del part[bisect_left(part, x)]
        self.size -= 1
        if not part and len(self.parts) > 1:
            del self.parts[k]

    def __getitem__(self, k: int) -> float:
        for part in self.parts:
            if k < len(part):
                return part[k]
            k -= len(part)
        raise IndexError(k)

    def quantile(self, q: float) -> float:
        """With linear interpolation between neighbours."""
        at = q * (self.size - 1)
        low = int(at)
        a = self[low]
        return a if low == at else (low + 1 - at) * a + (at - low) * self[low + 1]


def sliding_quantiles(values: np.ndarray, n: int, qs: list[float], block: int = 4096) -> Iterator[list[float]]:
    """For each value the quantiles of the last ``n`` values, missing until there are as many known ones in them."""
    window, missing = Sliding(block), [float("nan")] * len(qs)
    known = values.tolist()
    for i, x in enumerate(known):
        if x == x:
            window.add(x)
        if i >= n and known[i - n] == known[i - n]:
            window.remove(known[i - n])
        yield [window.quantile(q) for q in qs] if window.size == n else missing


def rolling_quantiles(df: DataFrame, within: list[str], x: Column, n: int, qs: Mapping[str, float]) -> DataFrame:
    """``df`` with exact quantiles ``qs`` (name to share) of the last ``n`` values of ``x``, null until there are as many.

    One pass over each group in order of time with an ordered window that moves along, instead of a sort for every row.
    """
    own = df.columns
    rows = df.withColumn("_x", finite(x.cast("double")))
    schema = T.StructType([*_fields(df, own), *(T.StructField(name, T.DoubleType()) for name in qs)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable").reset_index(drop=True)
        found = np.array(list(sliding_quantiles(part["_x"].to_numpy(dtype="float64"), n, list(qs.values()))))
        return pd.concat([part[own], pd.DataFrame(found, columns=list(qs))], axis=1)

    out = rows.groupBy(*within).applyInPandas(run, schema)
    return out.withColumns({name: F.nanvl(name, F.lit(None).cast("double")) for name in qs})
