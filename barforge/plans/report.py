"""Reports as small documents: one run's curves, and a preview of its last bars."""

from __future__ import annotations

import json
import math
import os
from array import array
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0"
SERIES = {"close": 8, "held": 6, "equity": 8, "drawdown": 8, "returns": 8, "fee": 8, "slippage": 8, "funding": 8}


def number(value: Any, digits: int) -> float | None:
    return None if value is None or not math.isfinite(value) else round(float(value), digits)


def columns(book: DataFrame) -> tuple[list[str], dict[str, array]]:
    """Times and series of one run's ledger in order of time, fetched a partition at a time into packed arrays; NaN where there is no number."""
    times: list[str] = []
    series = {c: array("d") for c in SERIES}
    for r in book.select(F.col("ts").cast("string").alias("ts"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in SERIES)).orderBy("ts").toLocalIterator():
        times.append(r["ts"])
        for c, values in series.items():
            values.append(r[c])
    return times, series


def plain(value: Any) -> Any:
    """``value`` with nothing in it that JSON lacks: numbers that aren't finite become null."""
    if isinstance(value, float):
        return number(value, 6)
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def report(book: DataFrame, run: Mapping, extra: Mapping | None = None) -> dict:
    """One run's curves as parallel lists beside its verdict; as long as the run, which is one series."""
    times, series = columns(book)
    lists = {c: [number(v, SERIES[c]) for v in values] for c, values in series.items()}
    return {"version": VERSION, "run": plain(run), "ts": times, **lists, "extra": plain(extra or {})}


def write_report(document: Mapping, folder: str) -> tuple[str, str]:
    """One text in two files of ``folder``: report.json, and report.js that a page loads without a server."""
    os.makedirs(folder, exist_ok=True)
    text = json.dumps(document, ensure_ascii=False, allow_nan=False)
    paths = os.path.join(folder, "report.json"), os.path.join(folder, "report.js")
    for path, body in zip(paths, (text, f"window.REPORT = {text};\n"), strict=True):
        with open(path, "w", encoding="utf-8") as f:
            f.write(body)
    return paths


def preview(bars: DataFrame, trades: DataFrame, last: int = 500) -> dict:
    """The last bars with their bands, and the trades that lie in them."""
    own = [c for c in ("open", "high", "low", "close", "z", "stop_price", "take_price", "target") if c in bars.columns]
    rows = bars.orderBy(F.desc("ts")).limit(last).select("ts", *own).collect()[::-1]
    since = rows[0]["ts"] if rows else None
    kept = trades.where(F.col("exit_ts") >= F.lit(since)).orderBy("entry_ts").collect() if rows else []
    return {
        "version": VERSION, "bars": [{"ts": str(r["ts"]), **{c: number(r[c], 8) for c in own}} for r in rows],
        "trades": [{k: number(v, 6) if isinstance(v, float) else str(v) if "ts" in k else v for k, v in t.asDict().items()} for t in kept],
    }
