"""Streams of ticks: tumbling bars with a watermark, and the bracket state machine with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.resample import bars_from_ticks


def stream_bars(ticks: DataFrame, keys: list[str], step: int, order: list[str], late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (keys, ts, price, size), emitted when the watermark has passed their end."""
    return bars_from_ticks(ticks.withWatermark("ts", late), keys, step, order)


def stream_brackets(bars: DataFrame, keys: list[str], max_bars: int) -> DataFrame:
    """Positions for a stream of bars with entry, stop_price and take_price; bars of a key must arrive in order.

    State is one small row for each key: side, age, stop, take, and whether the last bar closed a trade.
    """
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema.fields if f.name in [*keys, "ts"]) + ", target double"
    names = [f.name for f in bars.schema.fields if f.name in [*keys, "ts"]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, age, stop, take = state.get if state.exists else (0.0, 0, 0.0, 0.0)
        for batch in batches:
            batch, held = batch.sort_values("ts", kind="stable"), []
            for high, low, entry, sl, tp in batch[["high", "low", "entry", "stop_price", "take_price"]].itertuples(index=False):
                if side == 0 and entry:
                    side, age, stop, take = float(entry), 0, sl, tp
                elif side:
                    age += 1
                if side:
                    against, along = (low, high) if side > 0 else (-high, -low)
                    if against <= side * stop or along >= side * take or age >= max_bars:
                        side = 0.0
                held.append(side)
            yield batch[names].assign(target=held)
        state.update((side, age, stop, take))

    return bars.groupBy(*keys).applyInPandasWithState(run, out, "side double, age int, stop double, take double", "append", GroupStateTimeout.NoTimeout)


def checked(bars: DataFrame) -> DataFrame:
    """Bars with the clean mark, as for batches."""
    from ..operators.bars import clean

    return bars.withColumn("clean", F.coalesce(clean(), F.lit(False)))
