"""Kline and funding CSV files, with or without a header line, plain or zipped."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import PRICES, finite, keep_last

#: Columns of a raw kline file, in order (fixed values).
KLINE = "open_time open high low close volume close_time quote_volume count taker_buy_volume taker_buy_quote_volume ignore".split()

#: Columns of a raw funding file, in order (fixed values).
FUNDING = "calc_time funding_interval_hours last_funding_rate".split()


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of plain and zipped CSV files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = b"\n".join(z.read(n) for n in z.namelist())
                lines = data.decode("utf-8", "replace").splitlines()
                yield pd.DataFrame({"file": name, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line_no long, line string")


def _fields(lines: DataFrame) -> DataFrame:
    """Fields as ``f``; the first line of a file goes when its first field is no number."""
    split = lines.where(F.trim("line") != "").withColumn("f", F.split("line", ",", -1))
    return split.where(~((F.col("line_no") == 0) & F.get("f", F.lit(0)).try_cast("double").isNull()))


def parse_klines(lines: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """Canonical bars, and (file, dropped_rows). Times are in ms, or in µs where a file's median says so."""
    rows = _fields(lines).select("file", "line_no", *(F.trim(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(KLINE)))
    rows = rows.withColumn("_t", F.col("open_time").try_cast("double"))
    middle = F.percentile("_t", F.lit(0.5)).over(Window.partitionBy("file"))
    rows = rows.withColumn("_us", F.when(middle > 1e15, F.col("_t")).otherwise(F.col("_t") * 1000))
    number = lambda c: finite(F.col(c).try_cast("double"))
    typed = rows.select(
        "file", F.struct("file", "line_no").alias("_seq"), F.when(F.col("_us").between(0, 4e15), F.timestamp_micros(F.col("_us").cast("long"))).alias("ts"), *(number(c).alias(c) for c in PRICES),
        number("volume").alias("volume"), number("quote_volume").alias("quote_volume"), number("count").alias("trades"), number("taker_buy_volume").alias("taker_buy_volume"),
    )
    good = keep_last(typed.where(F.col("ts").isNotNull()).dropna(subset=list(PRICES)), ["ts"], "_seq")
    total = rows.groupBy("file").agg(F.count("*").alias("n"))
    kept = good.groupBy("file").agg(F.count("*").alias("k"))
    dropped = total.join(kept, "file", "left").select("file", (F.col("n") - F.coalesce("k", F.lit(0))).alias("dropped_rows"))
    return good.drop("file", "_seq").withColumn("symbol", F.lit(symbol)), dropped


def parse_funding(lines: DataFrame, symbol: str) -> DataFrame:
    """(symbol, ts, rate, interval_hours); a missing interval is eight hours.

    Columns go by a file's header line and, without one, by FUNDING's order. A header that lacks the time or the rate raises.
    """
    names = F.transform(F.split("line", ",", -1), lambda c: F.lower(F.trim(c)))
    first = lines.where(F.col("line_no") == 0).select(F.col("file").alias("_file"), names.alias("_names"))
    headed = first.where(F.get("_names", F.lit(0)).try_cast("double").isNull())
    place = lambda c: F.when(F.col("_names").isNull(), F.lit(FUNDING.index(c) + 1)).otherwise(F.array_position("_names", c)).cast("int")
    needed = lambda c: F.when(place(c) > 0, place(c)).otherwise(F.raise_error(F.concat(F.lit(f"no column {c} in "), F.col("file"))).cast("int"))
    at = {"t": needed("calc_time"), "hours": place("funding_interval_hours"), "rate": needed("last_funding_rate")}
    rows = _fields(lines).join(headed, F.col("file") == F.col("_file"), "left")
    rows = rows.select("file", "line_no", *(F.trim(F.get("f", i - 1)).alias(c) for c, i in at.items()))
    typed = rows.select(
        F.struct("file", "line_no").alias("_seq"), F.timestamp_millis(F.col("t").try_cast("double").cast("long")).alias("ts"), finite(F.col("rate").try_cast("double")).alias("rate"),
        F.coalesce(F.col("hours").try_cast("double").cast("long"), F.lit(8).cast("long")).alias("interval_hours"),
    )
    return keep_last(typed.dropna(subset=["ts", "rate"]), ["ts"], "_seq").drop("_seq").withColumn("symbol", F.lit(symbol)).select("symbol", "ts", "rate", "interval_hours")
