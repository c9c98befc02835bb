"""The selection funnel over the results store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import finite
from ..sources.runs_store import is_error
from .verdict import THRESHOLDS

GATES = ("trades", "dsr", "p_value", "pbo")
KEYS = ("min_trades", "min_dsr", "max_p_value", "max_pbo")
SORTABLE = ("sharpe", "dsr", "total_return", "trades")


def with_thresholds(runs: DataFrame) -> DataFrame:
    """``runs`` with each row's own gates and thresholds_known; a record that is missing, broken or partial counts as unknown."""
    raw = F.from_json("thresholds_json", ", ".join(f"{k} double" for k in KEYS), {"mode": "PERMISSIVE"})
    rows = runs.withColumn("_t", raw)
    known = F.lit(True)
    for k in KEYS:
        known = known & F.coalesce(F.abs(F.col(f"_t.{k}")) < float("inf"), F.lit(False))
    rows = rows.withColumn("thresholds_known", known)
    return rows.withColumns({k: F.when(F.col("thresholds_known"), F.col(f"_t.{k}")).otherwise(float(THRESHOLDS[k])) for k in KEYS}).drop("_t")


def with_gates(runs: DataFrame) -> DataFrame:
    """``runs`` (with_thresholds) with pass_trades, pass_dsr, pass_p_value, pass_pbo and survives: each gate after the one before."""
    no = F.lit(False)
    trades = F.coalesce(F.col("trades"), F.lit(0)) >= F.col("min_trades")
    dsr = trades & F.coalesce(finite(F.col("dsr")) > F.col("min_dsr"), no)
    p = dsr & F.coalesce(finite(F.col("p_value")) < F.col("max_p_value"), no)
    pbo = p & F.coalesce(finite(F.col("pbo")) < F.col("max_pbo"), no)
    return runs.withColumns({"pass_trades": trades, "pass_dsr": dsr, "pass_p_value": p, "pass_pbo": pbo, "survives": pbo & F.coalesce("alive", no)})


def threshold_summary(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, one column for each gate, mixed): the threshold that all rows share, null where they differ, the default where there are no rows.

    Each row is judged by its own; mixed says that shares of rows can't be compared with one another.
    """
    rows = with_thresholds(runs.where(~is_error()))
    ends = rows.groupBy(*(keys or [])).agg(F.count("*").alias("_n"), *(f(k).alias(f"_{f.__name__}_{k}") for k in KEYS for f in (F.min, F.max)))
    one = {k: F.when(F.col("_n") == 0, float(THRESHOLDS[k])).when(F.col(f"_min_{k}") == F.col(f"_max_{k}"), F.col(f"_min_{k}")) for k in KEYS}
    out = ends.select(*(keys or []), *(v.alias(k) for k, v in one.items()))
    unlike = F.lit(False)
    for k in KEYS:
        unlike = unlike | F.col(k).isNull()
    return out.withColumn("mixed", unlike)


def warnings(full: dict, coarse: dict) -> list[str]:
    """What a reader of the funnel must know, from its two blocks."""
    out = []
    if full["n"] and coarse["n"]:
        out.append(f"mixed grades: {full['n']} full and {coarse['n']} screening verdicts are counted apart; only full ones can be alive")
    for name, block in (("full", full), ("screening", coarse)):
        if block["thresholds"]["mixed"]:
            out.append(f"mixed thresholds among the {name} verdicts: each row is judged by its own")
        if block["thresholds_unknown"]:
            out.append(f"{block['thresholds_unknown']} {name} verdicts have no thresholds of their own and are judged by the defaults")
    return out


def funnel(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of one cohort for each key: n, the four gates, alive, and alive flags that fail some gate. One aggregation."""
    gated = with_gates(with_thresholds(runs.where(~is_error())))
    return gated.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), *(F.count_if(f"pass_{g}").alias(f"n_{g}") for g in GATES), F.count_if("survives").alias("n_alive"),
        F.count_if(F.coalesce("alive", F.lit(False)) & ~F.col("pass_pbo")).alias("alive_without_pbo"), F.count_if(~F.col("thresholds_known")).alias("thresholds_unknown"),
    )


def breakdown(runs: DataFrame, key: str) -> DataFrame:
    """For each value of ``key``: full verdicts by gate, and how many rows were screened or failed; the largest first."""
    rows = with_gates(with_thresholds(runs)).withColumns({"_failed": is_error(), "_screened": F.coalesce("screening", F.lit(False))})
    full = ~F.col("_failed") & ~F.col("_screened")
    out = rows.groupBy(key).agg(
        F.count_if(full).alias("n"), *(F.count_if(full & F.col(f"pass_{g}")).alias(f"n_{g}") for g in GATES), F.count_if(full & F.col("survives")).alias("n_alive"),
        F.count_if(~F.col("_failed") & F.col("_screened")).alias("n_screening"), F.count_if("_failed").alias("n_errors"),
    )
    return out.orderBy(F.desc("n"), key)


def reason_counts(runs: DataFrame) -> DataFrame:
    """(reason, n) of the pipe-joined reasons of verdicts."""
    each = F.explode(F.split("reasons", r" \| ", -1)).alias("reason")
    return runs.where(~is_error()).select(each).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def survivors(runs: DataFrame, sort: str = "sharpe", top: int = 10, order: str = "seq") -> DataFrame:
    """The best survivors; equal ones stay in the store's order, nulls come last. No survivor: no row."""
    if sort not in SORTABLE:
        raise ValueError(f"sort by one of {', '.join(SORTABLE)}")
    gated = with_gates(with_thresholds(runs.where(~is_error() & ~F.coalesce("screening", F.lit(False)))))
    return gated.where("survives").orderBy(F.col(sort).desc_nulls_last(), order).limit(top)


def _share(a: int, b: int) -> float | None:
    return round(a / b, 6) if b else None


def payload(runs: DataFrame, sort: str = "sharpe", top: int = 10, order: str = "seq") -> dict:
    """The funnel as one small document: counts only are brought to the driver."""

    def block(part: DataFrame) -> dict:
        row = funnel(part).first().asDict()
        thresholds = threshold_summary(part).first().asDict()
        n, before, steps = row["n"], row["n"], []
        for g, k in zip(GATES, KEYS, strict=True):
            steps.append({"key": g, "n": row[f"n_{g}"], "threshold": thresholds[k], "fraction_of_total": _share(row[f"n_{g}"], n), "fraction_of_previous": _share(row[f"n_{g}"], before)})
            before = row[f"n_{g}"]
        alive = {"n": row["n_alive"], "fraction_of_total": _share(row["n_alive"], n), "fraction_of_previous": _share(row["n_alive"], before)}
        return {"n": n, "steps": steps if n else [], "alive": alive, "alive_without_pbo": row["alive_without_pbo"], "thresholds_unknown": row["thresholds_unknown"], "thresholds": thresholds}

    screened = F.coalesce("screening", F.lit(False))
    full, coarse = block(runs.where(~screened)), block(runs.where(screened))
    permutations = runs.where(screened).agg(F.max("n_permutations")).first()[0] or 0
    candidates = coarse["steps"][-1]["n"] if coarse["steps"] else 0
    coarse |= {"candidates": candidates, "n_permutations": permutations, "min_achievable_p": round(1 / (permutations + 1), 6) if permutations else None}
    coarse["alive"] = {"n": 0, "fraction_of_total": 0.0, "fraction_of_previous": 0.0}
    best = [r.asDict() for r in survivors(runs, sort, top, order).select("config_id", "symbol", "timeframe", sort).collect()] if full["alive"]["n"] else None
    return {
        "version": 1, "funnel": full, "screening": coarse if coarse["n"] else None, "warnings": warnings(full, coarse), "errors": runs.where(is_error()).count(),
        "by_symbol": [r.asDict() for r in breakdown(runs, "symbol").collect()], "by_timeframe": [r.asDict() for r in breakdown(runs, "timeframe").collect()], "survivors": best,
    }


def write_payload(document: dict, json_path: str, js_path: str | None = None, name: str = "FUNNEL") -> None:
    """The same text as JSON and, for pages opened from disk, as a script."""
    text = json.dumps(document, ensure_ascii=False, allow_nan=False, indent=2, default=str)
    for path, content in ((json_path, text), (js_path, f"window.{name} = {text};\n")):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(content)
