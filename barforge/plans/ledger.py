"""The per-bar ledger of a target position: profit, costs, equity and drawdown, all as windows over one partitioning."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunks
from ..operators.chunks import Long
from ..schema import by_time, ratio

BPS = 1e-4
#: Fields that an experiment may set.
CONFIGURED = ("taker_fee_bps", "maker_fee_bps", "maker_share", "impact_coef", "min_slippage_bps")


@dataclass(frozen=True)
class Costs:
    """Fees of maker and taker orders and linear market impact."""

    taker_fee_bps: float = 5.0
    maker_fee_bps: float = 2.0
    maker_share: float = 0.0
    impact_coef: float = 0.1
    min_slippage_bps: float = 0.5
    charge_funding: bool = True

    @classmethod
    def from_config(cls, config: Mapping | None) -> Costs:
        """The CONFIGURED fields of a configuration; others are ignored, those without a value keep their default."""
        given = config or {}
        changes = [(name, given.get(name)) for name in CONFIGURED]
        return replace(cls(), **{name: value for name, value in changes if value is not None})

    @property
    def fee_bps(self) -> float:
        """The taker's fee, less what maker orders save of it."""
        saved = self.taker_fee_bps - self.maker_fee_bps
        return self.taker_fee_bps - saved * float(np.clip(self.maker_share, 0.0, 1.0))

    def slippage_bps(self, notional: Column, quote_volume: Column) -> Column:
        share = F.least(F.greatest(F.abs(notional) / F.when(quote_volume > 0, quote_volume), F.lit(0.0)), F.lit(1.0))
        return F.lit(self.min_slippage_bps) + F.coalesce(1e4 * self.impact_coef * share, F.lit(0.0))


FREE = Costs(0.0, 0.0, 0.0, 0.0, 0.0, charge_funding=False)


def held(target: str, keys: list[str]) -> Column:
    """The position during a bar: the target of the bar before, 0 at first. The series counts here, not its segments."""
    return F.lag(F.coalesce(F.col(target), F.lit(0.0)), 1, 0.0).over(by_time(keys))


def _finite_leg(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.raise_error(F.lit(f"{name} is not finite")).cast("double"))


def price_return(keys: list[str]) -> Column:
    return F.coalesce(ratio(F.col("close"), F.lag("close").over(by_time(keys))) - 1, F.lit(0.0))


def _flows(bars: DataFrame, keys: list[str], costs: Costs, capital: float, max_participation: float, legs: bool) -> DataFrame:
    """``bars`` with all columns of the ledger that look back two bars at most: positions, profit and costs."""
    net, gross, carry = ("net", "gross", "carry") if legs else ("target", "target", "target")
    at = by_time(keys)
    if legs:
        bars = bars.withColumns({c: _finite_leg(c) for c in ("gross", "carry")})
    lone = F.lag("ts").over(at).isNull() & F.lead("ts").over(at).isNull()
    moved = F.when(lone, F.raise_error(F.lit("a series has fewer than two bars")).cast("double")).otherwise(price_return(keys))
    out = bars.withColumns({"price_return": moved, "held": held(net, keys), "_basis": held(gross, keys), "_carry": held(carry, keys)})
    out = out.withColumn("turnover", F.coalesce(F.abs(F.col("_basis") - F.lag("_basis").over(at)), F.lit(0.0)))
    notional = F.col("turnover") * capital
    rate = F.coalesce("funding_rate", F.lit(0.0)) if costs.charge_funding and "funding_rate" in bars.columns else F.lit(0.0)
    out = out.withColumns(
        {
            "gross_held": F.abs("_basis"),
            "gross_return": F.col("held") * F.col("price_return"),
            "fee": F.col("turnover") * costs.fee_bps * BPS,
            "slippage": F.col("turnover") * costs.slippage_bps(notional, F.col("quote_volume")) * BPS,
            "funding": F.col("_carry") * rate,
            "cap_hit": F.coalesce(notional > max_participation * F.col("quote_volume"), F.lit(False)),
            "participation": F.coalesce(F.when(notional > 0, notional / F.when(F.col("quote_volume") > 0, F.col("quote_volume"))), F.lit(0.0)),
        }
    )
    return out.withColumn("returns", F.col("gross_return") - F.col("fee") - F.col("slippage") - F.col("funding")).drop("_basis", "_carry")


def ledger(
    bars: DataFrame, keys: list[str], costs: Costs = Costs(), capital: float = 10_000.0, max_participation: float = 0.01, initial: float = 1.0, legs: bool = False, long: Long | None = None,  # noqa: B008
) -> DataFrame:
    """``bars`` with the ledger's columns. ``bars`` has target, or with ``legs`` net, gross and carry; funding_rate if it is charged.

    Funding is paid by a long position at a positive rate. Turnover follows the signed position, or gross with ``legs``.
    A series of fewer than two bars raises, as does a gross or carry leg that is not finite. With ``long`` the series are cut: the
    flows come from chunks with a halo, equity and its peak from scans of the chunks' folds.
    """
    if not (max_participation > 0 and max_participation < float("inf")):
        raise ValueError("max_participation must be positive and finite")
    flows = lambda d, within: _flows(d, within, costs, capital, max_participation, legs)
    if long:
        series = [*keys, chunks.CHUNK]  # a position is held across segments
        out = chunks.apply_with_halo(chunks.numbered(bars, keys, long), keys, long, 2, lambda d, _: flows(d, series), after=1)
        out = chunks.running(out, keys, long, products={"equity": 1 + F.col("returns")}).withColumn("equity", initial * F.col("equity"))
        out = chunks.running(out, keys, long, maxima={"peak": F.col("equity")})
    else:
        upto = by_time(keys).rowsBetween(Window.unboundedPreceding, 0)
        out = flows(bars, keys).withColumn("equity", initial * F.product(1 + F.col("returns")).over(upto))
        out = out.withColumn("peak", F.max("equity").over(upto))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def totals(book: DataFrame, keys: list[str]) -> DataFrame:
    """Cost totals, capacity figures and the end of the curve for each run."""
    return book.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.sum("fee").alias("fee"), F.sum("slippage").alias("slippage"), F.sum("funding").alias("funding"), F.sum("turnover").alias("turnover"),
        F.count_if("cap_hit").alias("cap_hits"), F.max("participation").alias("max_participation_observed"), (F.count_if("cap_hit") > 0).alias("over_capacity"),
        F.max_by("equity", "ts").alias("equity_end"), F.min("drawdown").alias("max_drawdown"),
    )


def _scanned(book: DataFrame, keys: list[str], long: Long | None, mark: Callable[[DataFrame, list[str]], DataFrame], **sums: str) -> DataFrame:
    """``mark(book, keys)``, which looks one bar back, with running sums of columns it makes."""
    if long:
        marked = chunks.apply_with_halo(chunks.numbered(book, keys, long), keys, long, 1, lambda d, _: mark(d, [*keys, chunks.CHUNK]))
        return chunks.running(marked, keys, long, sums={name: F.col(c) for name, c in sums.items()})
    upto = by_time(keys).rowsBetween(Window.unboundedPreceding, 0)
    return mark(book, keys).withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})


def trade_amounts(book: DataFrame, keys: list[str], long: Long | None = None) -> DataFrame:
    """(keys, trade_id, ts, amount): what each bar adds to which trade; a bar on which a trade ends or turns adds to two."""

    def mark(d: DataFrame, within: list[str]) -> DataFrame:
        side, before = F.signum("held"), F.coalesce(F.lag("held").over(by_time(within)), F.lit(0.0))
        return d.withColumns({"_side": side, "_was": before, "_starts": ((side != 0) & (side != F.signum(before))).cast("int")})

    rows = _scanned(book, keys, long, mark, _id="_starts")
    cost, own = F.col("fee") + F.col("slippage"), F.col("gross_return") - F.col("funding")
    ends = (F.signum("_was") != 0) & (F.signum("_was") != F.col("_side"))
    closing = F.when(~ends, 0.0).when(F.col("_side") == 0, 1.0).otherwise(F.abs("_was") / (F.abs("_was") + F.abs("held")))
    now = F.when(F.col("_side") != 0, F.struct(F.col("_id").alias("trade_id"), (own - (1 - closing) * cost).alias("amount")))
    then = F.when(ends, F.struct((F.col("_id") - F.col("_starts")).alias("trade_id"), (-closing * cost).alias("amount")))
    return rows.select(*keys, "ts", F.explode(F.array_compact(F.array(now, then))).alias("e")).select(*keys, "e.trade_id", "ts", "e.amount")


def trade_returns(book: DataFrame, keys: list[str], long: Long | None = None) -> DataFrame:
    """(keys, trade_id, trade_return); nothing for books without direction. Sums to the returns of directional books."""
    return trade_amounts(book, keys, long).groupBy(*keys, "trade_id").agg(F.sum("amount").alias("trade_return"))


def episodes(book: DataFrame, keys: list[str], long: Long | None = None) -> DataFrame:
    """One row for each stretch with an open book, the bar on which it closes included."""

    def mark(d: DataFrame, within: list[str]) -> DataFrame:
        active = F.col("gross_held") > 0
        was = F.coalesce(F.lag(active).over(by_time(within)), F.lit(False))
        return d.withColumns({"_on": active | was, "_new": (active & ~was).cast("int")})

    rows = _scanned(book, keys, long, mark, episode="_new").withColumn("episode", F.col("episode") - 1).where("_on")
    return rows.groupBy(*keys, "episode").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"), F.sum("gross_return").alias("price_pnl"), (-F.sum("funding")).alias("funding_income"),
        F.sum("fee").alias("fee"), F.sum("slippage").alias("slippage"), F.sum("returns").alias("net_return"),
    )


def is_delta_neutral(book: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, delta_neutral): no net position on any bar, yet some turnover."""
    return book.groupBy(*keys).agg(((F.count_if(F.col("held") != 0) == 0) & (F.sum("turnover") > 0)).alias("delta_neutral"))


def transitions(book: DataFrame, keys: list[str], inside: Column, position: str = "gross_held") -> DataFrame:
    """(keys, entries, exits, bars) among the bars where ``inside`` holds."""
    on = F.col(position) > 0
    was = F.coalesce(F.lag(on).over(by_time(keys)), F.lit(False))
    rows = book.withColumns({"_in": on & ~was, "_out": ~on & was, "_inside": inside})
    return rows.where("_inside").groupBy(*keys).agg(F.count_if("_in").alias("entries"), F.count_if("_out").alias("exits"), F.count("*").alias("bars"))
