"""From monthly archives into the lake: what it lacks is downloaded, parsed and written, symbol by symbol."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import klines, lake
from .archive import ArchiveSource, months


@dataclass(frozen=True)
class Ingested:
    """What became of a symbol's archives. ``absent``: months that the server hasn't; ``excluded``: not written, as its history ends early."""

    symbol: str
    kind: str
    fetched: int = 0
    skipped: int = 0
    absent: int = 0
    dropped_rows: int = 0
    truncated: bool = False
    excluded: bool = False
    error: str = ""


class Staging:
    """A folder beside the lake for what was downloaded, so that nothing is asked of the server twice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/_staging-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def archive_lines(spark: SparkSession, source: type[ArchiveSource], symbol: str, wanted: list[str], **options: str) -> DataFrame:
    """Lines of a symbol's archives of the months ``wanted``; the filters go down to the source, so no other month is asked for."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format(source.name()).options(symbols=symbol, first=min(wanted), last=max(wanted), pushdown="true", **options).load()
    return found.where((F.col("symbol") == symbol) & F.col("month").isin(wanted))


def _counts(lines: DataFrame) -> int:
    return lines.select("month").distinct().count()


def ingest_bars(spark: SparkSession, root: str, source: type[ArchiveSource], base: str, symbol: str, freq: str, first: str, last: str, now: datetime, include_delisted: bool = True, force: bool = False) -> Ingested:
    """Download the months of bars that the lake lacks (all of them with ``force``) and write them."""
    every = months(first, last)
    wanted = every if force else sorted(r["month"] for r in lake.months_to_fetch(spark, root, freq, [symbol], first, last).collect())  # months of one symbol
    skipped, staging = len(every) - len(wanted), Staging(spark, root)
    if not wanted:
        return Ingested(symbol, "klines", skipped=skipped)
    try:
        lines = staging.kept(archive_lines(spark, source, symbol, wanted, base=base, kind="klines", freq=freq))
        fetched = _counts(lines)
        # Files of two months may share a name inside their archives.
        found, dropped = klines.parse_klines(lines.withColumn("file", F.concat_ws("/", "month", "file")), symbol)
        found = staging.kept(found)
        known = found.select("symbol", "ts")
        if skipped:
            known = known.unionByName(lake.load_bars(spark, root, symbol, freq, f"{first}-01").select("symbol", "ts"))
        history = lake.truncated_history(known, now).first()
        truncated = bool(history and history["truncated"] and last > f"{history['last_ts']:%Y-%m}") or bool(history and history["ends_early"])
        excluded = truncated and not include_delisted
        if fetched and not excluded:
            lake.write_bars(found, root, freq)
        rows = dropped.agg(F.coalesce(F.sum("dropped_rows"), F.lit(0)).alias("n")).first()["n"]
        return Ingested(symbol, "klines", fetched, skipped, len(wanted) - fetched, rows, truncated, excluded)
    finally:
        staging.remove()


def ingest_funding(spark: SparkSession, root: str, source: type[ArchiveSource], base: str, symbol: str, first: str, last: str, force: bool = False) -> Ingested:
    """Download the months without a funding event and write them with those that the lake has."""
    try:
        have = lake.load_funding(spark, root, symbol)
        there = {r["m"] for r in have.select(F.date_format("ts", "yyyy-MM").alias("m")).distinct().collect()}  # months of one symbol
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have, there = None, set()
    every = months(first, last)
    wanted = [m for m in every if force or m not in there]
    if not wanted:
        return Ingested(symbol, "funding", skipped=len(every))
    staging = Staging(spark, root)
    try:
        lines = staging.kept(archive_lines(spark, source, symbol, wanted, base=base, kind="fundingRate"))
        fetched = _counts(lines)
        if fetched:
            events = klines.parse_funding(lines.withColumn("file", F.concat_ws("/", "month", "file")), symbol).withColumn("_order", F.lit(1))
            if have is not None:
                events = events.unionByName(have.withColumn("_order", F.lit(0)))
            lake.write_funding(staging.kept(events), root, "_order")
        return Ingested(symbol, "funding", fetched, len(every) - len(wanted), len(wanted) - fetched)
    finally:
        staging.remove()


def ingest_symbols(spark: SparkSession, root: str, base: str, symbols: list[str], freq: str, first: str, last: str, now: datetime, source: type[ArchiveSource] = ArchiveSource, include_delisted: bool = True, force: bool = False, done: Callable[[Ingested], None] = lambda _: None) -> list[Ingested]:
    """Bars and funding of each symbol by itself: one that fails spoils no other and keeps what was written before."""
    out: list[Ingested] = []
    for symbol in symbols:
        for kind, run in (
            ("klines", lambda s: ingest_bars(spark, root, source, base, s, freq, first, last, now, include_delisted, force)),
            ("funding", lambda s: ingest_funding(spark, root, source, base, s, first, last, force)),
        ):
            try:
                out.append(run(symbol))
            except Exception as e:
                out.append(Ingested(symbol, kind, error=f"{type(e).__name__}: {str(e)[:300]}"))
            done(out[-1])
            if out[-1].error or out[-1].excluded:
                break
    return out
