"""Verdicts: which runs pass every gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, significance

#: Gates by default (fixed values).
THRESHOLDS = {"min_trades": 100, "min_dsr": 0.95, "max_p_value": 0.05, "max_pbo": 0.5, "n_permutations": 1000}
SCREENING_PERMUTATIONS = 200
SCREENING = "screening: few permutations, nothing is alive by it"
NO_PBO = "overfitting not judged: a single run has no matrix of configurations"
NO_EXPOSURE = "permutation test not applicable: no price exposure"
NO_DIRECTION = "min_trades not applicable: no directional trades"


def verdicts(
    book: DataFrame, trades: DataFrame, keys: list[str], n_trials: int, periods: float, pbo: DataFrame | None = None,
    thresholds: Mapping | None = None, screening: bool = False, unjudged: str | None = None, notes: Sequence[str] = (),
) -> DataFrame:
    """A row for each run. ``book``: its ledger; ``trades``: its trade returns; ``pbo``: one row (pbo) of the sweep's matrix, or a row for each of some keys;
    where it has ``unjudged``, that says why there is no value.

    reasons say why a run fails, warnings what was not judged, inapplicable which gates mean nothing for its book. A run is
    alive without reasons and inapplicable gates, unless it is only screened. ``unjudged``: why there is no ``pbo``. ``notes``: further warnings.
    """
    if not 0 < periods < float("inf"):
        raise ValueError("periods must be positive and finite")
    t = {**THRESHOLDS, **(thresholds or {})}
    n = SCREENING_PERMUTATIONS if screening else int(t["n_permutations"])
    base = metrics.summary(book, trades, keys, periods)
    seen = book.groupBy(*keys).agg(F.max(F.abs("held")).alias("_exposed"), F.max(F.abs("returns")).alias("_moved"), (F.sum("fee") + F.sum("slippage") + F.sum("funding")).alias("cost_total"))
    rows = base.join(seen, keys).join(significance.deflated_sharpe(book, keys, n_trials), keys).join(significance.permutation_test(book, keys, n), keys)
    if pbo is None:
        rows = rows.withColumn("pbo", F.lit(None).cast("double"))
    else:
        on = [c for c in pbo.columns if c not in ("pbo", "unjudged")]
        rows = rows.join(pbo, on, "left") if on else rows.crossJoin(F.broadcast(pbo))  # a single row
    if "unjudged" not in rows.columns:
        rows = rows.withColumn("unjudged", F.lit((unjudged or NO_PBO) if pbo is None else None).cast("string"))
    idle, off = F.col("_exposed") == 0, (F.col("_exposed") == 0) & (F.col("_moved") > 0)
    number = lambda c: F.format_string("%.3f", F.col(c))
    few = F.when((F.col("trades") < t["min_trades"]) & ~off, F.concat(F.lit("too few trades: "), F.col("trades").cast("string"), F.lit(f" < {t['min_trades']}")))
    dsr = F.when(F.coalesce(F.col("dsr") <= t["min_dsr"], F.lit(True)), F.concat(F.lit("DSR "), number("dsr"), F.lit(f" <= {t['min_dsr']} after {n_trials} trials")))
    p = F.when(~idle & F.coalesce(F.col("p_value") >= t["max_p_value"], F.lit(True)), F.concat(F.lit("p-value "), number("p_value"), F.lit(f" >= {t['max_p_value']}")))
    wide = F.when(F.col("pbo").isNull(), "PBO can't be computed").when(F.col("pbo") >= t["max_pbo"], F.concat(F.lit("PBO "), number("pbo"), F.lit(f" >= {t['max_pbo']}")))
    fit = F.when(F.col("unjudged").isNull(), wide)
    said = [F.lit(w) for w in ([SCREENING] if screening else [])]
    rows = rows.withColumns(
        {
            "reasons": F.array_compact(F.array(few, dsr, p, fit)),
            "warnings": F.array_compact(F.array(*said, F.col("unjudged"), *map(F.lit, notes))),
            "inapplicable": F.array_compact(F.array(F.when(idle, NO_EXPOSURE), F.when(off, NO_DIRECTION))),
            "n_trials": F.lit(n_trials).cast("long"), "n_permutations": F.lit(n).cast("long"), "screening": F.lit(screening),
        }
    ).drop("_exposed", "_moved", "unjudged")
    return rows.withColumn("alive", (F.size("reasons") == 0) & (F.size("inapplicable") == 0) & ~F.col("screening"))


def status() -> Column:
    """alive, not rendered (some gate means nothing for the book), candidate (screened, no reasons) or dead."""
    reasons, none = F.size("reasons") > 0, F.size("inapplicable") > 0
    return F.when(F.col("alive"), "alive").when(reasons, "dead").when(none, "not rendered").when(F.col("screening"), "candidate").otherwise("dead")
