"""Strategies: a function from bars to target positions, and the registry through which others are added.

Features and state begin anew in every segment, so a strategy partitions by series keys and ``segment``.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, features, kernels, paths
from ..operators.chunks import Long
from ..schema import by_time


class Strategy(Protocol):
    """``generate`` adds ``target``; with ``legs`` it adds net, gross and carry instead. ``history`` is its memory in bars;
    a strategy that is not ``recursive`` reads nothing before it."""

    name: str
    legs: bool
    needs_funding: bool
    recursive: bool

    def generate(self, bars: DataFrame, within: list[str]) -> DataFrame: ...

    @property
    def history(self) -> int: ...


REGISTRY: dict[str, type] = {}


def register(cls: type) -> type:
    if cls.name in REGISTRY:
        raise ValueError(f"strategy {cls.name!r} is registered already")
    REGISTRY[cls.name] = cls
    return cls


def make(name: str, params: Mapping | None = None) -> Strategy:
    if name not in REGISTRY:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](params)


class Parametrised:
    defaults: Mapping = {}
    legs = False
    needs_funding = False
    recursive = True

    def __init__(self, params: Mapping | None = None):
        unknown = set(params or {}) - set(self.defaults)
        if unknown:
            raise ValueError(f"{type(self).name} has no parameter {', '.join(sorted(unknown))}")
        self.params = {**self.defaults, **(params or {})}

    def __getattr__(self, name: str):
        try:
            return self.__dict__["params"][name]
        except KeyError:
            raise AttributeError(name) from None


@register
class Threshold(Parametrised):
    """Long below -k, short above +k deviations; no exits but the signal's end. All window expressions."""

    name = "threshold"
    recursive = False
    defaults = {"window": 20, "k": 1.0}

    @property
    def history(self) -> int:
        return int(self.window)

    def generate(self, bars: DataFrame, within: list[str]) -> DataFrame:
        z = features.zscore(F.col("close"), within, int(self.window))
        return bars.withColumn("z", z).withColumn("target", F.when(F.col("z") <= -self.k, 1.0).when(F.col("z") >= self.k, -1.0).otherwise(0.0))


#: What a run of MeanReversion adds to its bars beside the target.
EXTRA = ("atr", "z", "entry", "stop_price", "take_price")


@register
class MeanReversion(Parametrised):
    """Entries at a distance from the mean, exits by stop, take or time."""

    name = "mean_reversion"
    defaults = {
        "window": 20, "k": 2.0, "atr_len": 14, "sl_atr": 2.0, "tp_atr": 3.0, "max_bars": 500,
        "use_hl_filter": False, "hl_min": 5.0, "hl_max": 100.0, "hl_window": 200,
    }
    adx_length: int | None = None

    @property
    def history(self) -> int:
        return max(int(self.window), int(self.atr_len), features.atr_memory(int(self.atr_len)), int(self.hl_window) if self.use_hl_filter else 0)

    def thresholds(self, bars: DataFrame, within: list[str]) -> DataFrame:
        """``bars`` (with z) with _low and _high: a hook for adaptive thresholds."""
        return bars.withColumns({"_low": F.lit(-float(self.k)), "_high": F.lit(float(self.k))})

    def allowed(self, bars: DataFrame, within: list[str]) -> tuple[DataFrame, Column]:
        """``bars`` with what the filters need, and where entries are allowed: a hook for regime filters."""
        if not self.use_hl_filter:
            return bars, F.lit(True)
        return features.half_life_ok(bars, within, int(self.hl_window), float(self.hl_min), float(self.hl_max)), F.col("hl_ok")

    def entries(self, wide: DataFrame, within: list[str]) -> DataFrame:
        """``wide`` (with atr) with z, entry and the prices of its brackets; reads ``self.lookback`` bars at most."""
        n = int(self.window)
        wide = wide.withColumns({"z": features.zscore(F.col("close"), within, n), "_row": F.row_number().over(by_time(within))})
        wide, allowed = self.allowed(self.thresholds(wide, within), within)
        ready = F.col("_row") >= max(n, int(self.atr_len))
        safe = F.col("atr").isNotNull() & F.col("close").isNotNull()
        side = F.when(F.col("z") >= F.col("_high"), -1.0).when(F.col("z") <= F.col("_low"), 1.0)
        entry = F.coalesce(F.when(ready & safe & allowed, side), F.lit(0.0))
        reach = lambda m: F.col("entry") * F.col("atr") * m
        return wide.withColumn("entry", entry).withColumns({"stop_price": F.col("close") - reach(float(self.sl_atr)), "take_price": F.col("close") + reach(float(self.tp_atr))})

    @property
    def lookback(self) -> int:
        """The bars before one that entries() reads, average ranges left out."""
        return max(int(self.window), int(self.atr_len), int(self.hl_window) + 1 if self.use_hl_filter else 0)

    def generate(self, bars: DataFrame, within: list[str]) -> DataFrame:
        wide = kernels.with_ranges(bars, within, int(self.atr_len), self.adx_length)
        wide = self.entries(wide.withColumn("atr", F.nanvl("atr", F.lit(None))), within)
        return kernels.with_brackets(wide.select(*bars.columns, *(c for c in EXTRA if c not in bars.columns)), within, int(self.max_bars))

    def generate_long(self, bars: DataFrame, keys: list[str], long: Long) -> DataFrame:
        """The same on numbered series that are cut into chunks."""
        wide = paths.ranges(bars, keys, long, int(self.atr_len), self.adx_length)
        wide = chunks.apply_with_halo(wide, keys, long, self.lookback, self.entries)
        return paths.brackets(wide.select(*bars.columns, *(c for c in EXTRA if c not in bars.columns)), keys, int(self.max_bars), long)


@register
class FilteredMeanReversion(MeanReversion):
    """With regime filters; all of them off leave MeanReversion as it is. A filter that is not ready forbids entries."""

    name = "mean_reversion_filtered"
    defaults = {
        **MeanReversion.defaults, "adx_period": 14, "adx_max": None, "adx_min": None, "quantile_window": 0, "coverage": 90.0, "squeeze_window": 100, "squeeze_ratio": None,
    }

    def __init__(self, params: Mapping | None = None):
        super().__init__(params)
        if self.adx_max is not None or self.adx_min is not None:
            self.adx_length = int(self.adx_period)

    @property
    def history(self) -> int:
        n = int(self.window)
        more = [features.adx_memory(int(self.adx_period))] if self.adx_length else []
        more += [n + int(self.quantile_window) - 1] if self.quantile_window > 0 else []
        more += [n + int(self.squeeze_window) - 1] if self.squeeze_ratio is not None else []
        return max(super().history, *more, 1)

    @property
    def lookback(self) -> int:
        n = int(self.window)
        more = [n + int(self.quantile_window)] if self.quantile_window > 0 else []
        return max(super().lookback, *more, n + int(self.squeeze_window) if self.squeeze_ratio is not None else 0)

    def thresholds(self, bars: DataFrame, within: list[str]) -> DataFrame:
        if self.quantile_window <= 0:
            return super().thresholds(bars, within)
        tail, n = (1 - float(self.coverage) / 100) / 2, int(self.quantile_window)
        real = bars.withColumn("_z", F.when(F.col("_row") >= int(self.window), F.col("z")))
        return paths.rolling_quantiles(real, within, F.col("_z"), n, {"_low": tail, "_high": 1 - tail})

    def allowed(self, bars: DataFrame, within: list[str]) -> tuple[DataFrame, Column]:
        bars, ok = super().allowed(bars, within)
        adx = F.nanvl("adx", F.lit(None)) if self.adx_length else None
        if self.adx_max is not None:
            ok = ok & F.coalesce(adx < float(self.adx_max), F.lit(False))
        if self.adx_min is not None:
            ok = ok & F.coalesce(adx > float(self.adx_min), F.lit(False))
        if self.squeeze_ratio is not None:
            bars = features.squeeze(F.col("close"), bars, within, int(self.window), int(self.squeeze_window), float(self.squeeze_ratio))
            ok = ok & F.col("squeezed")
        return bars, ok


def recovery_threshold(fee_bps: float, slippage_bps: float, horizon: int) -> float:
    """The mean rate that pays for entering and leaving both legs within ``horizon`` bars."""
    return 4 * (fee_bps + slippage_bps) * 1e-4 / horizon


@register
class FundingHarvest(Parametrised):
    """A delta-neutral book, held while the mean of the last rates is above a threshold. -inf: always, +inf: never."""

    name = "funding_harvest"
    legs = True
    needs_funding = True
    recursive = False
    defaults = {"window": 24, "threshold_rate": 0.0, "weight": 1.0}

    @property
    def history(self) -> int:
        return 1 if abs(self.threshold_rate) == float("inf") else int(self.window)

    def generate(self, bars: DataFrame, within: list[str]) -> DataFrame:
        if "funding_rate" not in bars.columns:
            raise ValueError("funding_harvest needs funding_rate")
        rate = F.col("funding_rate")
        checked = F.when(F.coalesce(F.abs(rate) < float("inf"), F.lit(False)), rate).otherwise(F.raise_error(F.lit("a funding rate is not finite")).cast("double"))
        wide, w = bars.withColumn("funding_rate", checked), float(self.weight)
        if abs(self.threshold_rate) == float("inf"):
            on = F.lit(self.threshold_rate < 0)
        else:
            on = F.coalesce(features.rolling_mean(F.col("funding_rate"), within, int(self.window)) > self.threshold_rate, F.lit(False))
        wide = wide.withColumn("_on", on)
        return wide.withColumns({"net": F.lit(0.0), "gross": F.when(F.col("_on"), 2 * w).otherwise(0.0), "carry": F.when(F.col("_on"), -w).otherwise(0.0)}).drop("_on")


def run_segmented(strategy: Strategy, bars: DataFrame, keys: list[str], long: Long | None = None) -> DataFrame:
    """Targets from each gap-free segment by itself; needs ``segment``.

    With ``long`` the series are cut: one that is not recursive runs on chunks with its history as halo, a recursive one has to bring
    its own ``generate_long(bars, keys, long)``.
    """
    if not long:
        return strategy.generate(bars, [*keys, "segment"])
    rows = chunks.numbered(bars, keys, long)
    if not strategy.recursive:
        return chunks.apply_with_halo(rows, keys, long, int(strategy.history), strategy.generate)
    if not hasattr(strategy, "generate_long"):
        raise ValueError(f"{strategy.name} can't run on cut series")
    return strategy.generate_long(rows, keys, long)


def mask_targets(bars: DataFrame, strategy: Strategy) -> DataFrame:
    """No target on bars that can't be traded; targets are masked, and held positions follow from them."""
    legs = ("net", "gross", "carry") if strategy.legs else ("target",)
    return bars.withColumns({c: F.when(F.col("tradable"), F.col(c)).otherwise(0.0) for c in legs})
