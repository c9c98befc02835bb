"""The Parquet lake: ``bars/symbol=/freq=/month=`` and ``funding/symbol=``."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import UTC, date, datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import resample as to_timeframe
from ..schema import BAR_COLUMNS, keep_last, normalize_bars, step_seconds


def _utc(at: datetime) -> datetime:
    """``at`` without a zone; one with an offset is moved to UTC first."""
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def _instant(value: str | date | datetime) -> tuple[datetime, bool]:
    """The instant in UTC, and whether only a day was given."""
    if isinstance(value, datetime):
        return _utc(value), False
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day), True
    text = value.strip()
    return _utc(datetime.fromisoformat(text.replace("Z", "+00:00"))), re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) is not None


def _literal(ts: datetime, zoned: bool) -> Column:
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp" if zoned else "timestamp_ntz")


def between(column: str, start=None, end=None, zoned: bool = False) -> Column:
    """A range that reaches the scan: a day as end takes in the whole day, an explicit time is included as it is."""
    ok, c = F.lit(True), F.col(column)
    if start is not None:
        ok = ok & (c >= _literal(_instant(start)[0], zoned))
    if end is not None:
        at, whole_day = _instant(end)
        ok = ok & (c < _literal(at + timedelta(days=1), zoned) if whole_day else c <= _literal(at, zoned))
    return ok


def load_bars(spark: SparkSession, root: str, symbol: str | list[str], freq: str, start=None, end=None, resample: str | None = None) -> DataFrame:
    """Bars of one symbol or several; partitions outside the range are not read. Raises FileNotFoundError when there are none."""
    try:
        found = spark.read.parquet(f"{root}/bars").where(F.col("symbol").isin(symbol) & (F.col("freq") == freq))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no bars below {root}") from e
        raise
    for edge, op in ((start, "__ge__"), (end, "__le__")):
        if edge is not None:
            found = found.where(getattr(F.col("month").cast("string"), op)(_instant(edge)[0].strftime("%Y-%m")))
    zoned = dict(found.dtypes)["ts"] == "timestamp"
    found = found.where(between("ts", start, end, zoned)).select("symbol", *BAR_COLUMNS)
    if found.isEmpty():
        raise FileNotFoundError(f"no bars of {symbol} {freq} in the range")
    return to_timeframe(found, ["symbol"], freq, resample) if resample else found


def read_bars(spark: SparkSession, root: str, symbol: str, freq: str, start=None, end=None) -> DataFrame:
    """Bars of one symbol with every rule of the lake applied again, for files that another program may have written."""
    found = load_bars(spark, root, symbol, freq, start, end)
    return normalize_bars(found.withColumn("_order", F.monotonically_increasing_id()), ["symbol"], "_order")


def write_bars(bars: DataFrame, root: str, freq: str, sequence: str | None = None) -> None:
    """Bars with symbol, normalised; the months that occur are replaced, others stay."""
    step_seconds(freq)
    rows = bars if sequence else bars.withColumn("_order", F.monotonically_increasing_id())
    rows = normalize_bars(rows, ["symbol"], sequence or "_order").withColumns({"freq": F.lit(freq), "month": F.date_format("ts", "yyyy-MM")})
    rows = rows.repartition("symbol", "freq", "month").sortWithinPartitions("symbol", "month", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol", "freq", "month").parquet(f"{root}/bars")


def load_funding(spark: SparkSession, root: str, symbol: str | list[str]) -> DataFrame:
    return spark.read.parquet(f"{root}/funding").where(F.col("symbol").isin(symbol)).select("symbol", "ts", "rate", "interval_hours")


def write_funding(events: DataFrame, root: str, sequence: str | None = None) -> None:
    rows = events if sequence else events.withColumn("_order", F.monotonically_increasing_id())
    rows = keep_last(rows.select("symbol", "ts", "rate", "interval_hours", F.col(sequence or "_order").alias("_seq")), ["symbol", "ts"], "_seq").drop("_seq")
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol").parquet(f"{root}/funding")


def month_table(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(month) from ``first`` to ``last``, both as YYYY-MM."""
    return spark.sql(f"SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence(DATE'{first}-01', DATE'{last}-01', INTERVAL 1 MONTH)) AS m)")


def complete_symbols(rows: DataFrame, first: str, last: str) -> DataFrame:
    """(symbol, months, complete): how many of the months each symbol has."""
    wanted = month_table(rows.sparkSession, first, last)
    n = wanted.count()
    months = rows.select("symbol", F.date_format("ts", "yyyy-MM").alias("month")).distinct().join(F.broadcast(wanted), "month", "left_semi")  # n rows
    counts = months.groupBy("symbol").agg(F.count("*").alias("months"))
    return rows.select("symbol").distinct().join(counts, "symbol", "left").select("symbol", F.coalesce("months", F.lit(0)).alias("months"), (F.coalesce("months", F.lit(0)) == n).alias("complete"))


def coverage(bar_months: DataFrame, funding_months: DataFrame, first: str, last: str) -> DataFrame:
    """(symbol, missing_bar_months, missing_funding_months, complete) of each symbol with bars, from tables of (symbol, month)."""
    wanted = month_table(bar_months.sparkSession, first, last)
    n = wanted.count()

    def have(rows: DataFrame, name: str) -> DataFrame:
        inside = rows.select("symbol", "month").distinct().join(F.broadcast(wanted), "month", "left_semi")  # n rows
        return inside.groupBy("symbol").agg(F.count("*").alias(name))

    out = bar_months.select("symbol").distinct().join(have(bar_months, "_b"), "symbol", "left").join(have(funding_months, "_f"), "symbol", "left")
    out = out.select("symbol", *((F.lit(n) - F.coalesce(c, F.lit(0))).cast("long").alias(f"missing_{kind}_months") for c, kind in (("_b", "bar"), ("_f", "funding"))))
    return out.withColumn("complete", (F.col("missing_bar_months") == 0) & (F.col("missing_funding_months") == 0))


def discover_symbols(spark: SparkSession, root: str, freq: str, first: str, last: str) -> DataFrame:
    """coverage() of a lake: a month counts when it has bars and, for funding, an event."""
    try:
        events = spark.read.parquet(f"{root}/funding").select("symbol", F.date_format("ts", "yyyy-MM").alias("month"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        events = spark.createDataFrame([], "symbol string, month string")
    return coverage(finished_months(spark, root, freq), events, first, last)


def truncated_history(rows: DataFrame, now: datetime) -> DataFrame:
    """(symbol, last_ts, missing_months, ends_early, truncated): finished months missing after the last, or a last month that stops over a day early."""
    last = rows.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    month_end = F.add_months(F.trunc("last_ts", "month"), 1).cast("timestamp_ntz")
    current = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    behind = F.months_between(F.lit(current.isoformat(sep=" ")).cast("timestamp_ntz"), F.trunc("last_ts", "month")).cast("int") - 1
    early = (month_end <= _literal(current, False)) & (F.col("last_ts").cast("timestamp_ntz") < month_end - F.expr("interval 1 day"))
    out = last.withColumns({"missing_months": F.greatest(behind, F.lit(0)), "ends_early": early})
    return out.withColumn("truncated", (F.col("missing_months") > 0) | F.col("ends_early"))


def finished_months(spark: SparkSession, root: str, freq: str) -> DataFrame:
    """(symbol, month) with rows; counts come from Parquet footers."""
    try:
        found = spark.read.parquet(f"{root}/bars").where(F.col("freq") == freq)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "symbol string, month string")
        raise
    return found.groupBy("symbol", F.col("month").cast("string").alias("month")).count().where("count > 0").drop("count")


def months_to_fetch(spark: SparkSession, root: str, freq: str, symbols: list[str], first: str, last: str) -> DataFrame:
    """The (symbol, month) that the lake lacks."""
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    cells = month_table(spark, first, last).withColumn("symbol", F.explode(F.array(*map(F.lit, symbols)))) if symbols else names.withColumn("month", F.lit(""))
    return cells.join(finished_months(spark, root, freq), ["symbol", "month"], "left_anti").select("symbol", "month")


#: Where a lake keeps what its files' contents came to, by path, size and time of change.
VERSIONS = "_content.json"


def _row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of a whole row in which a missing value counts, whatever the order of columns in the file."""
    parts = [x for c in sorted(df.columns) for x in (F.lit(c), F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")


def _files(spark: SparkSession, root: str) -> tuple:
    """The lake's file system, and (size, time of change) of its Parquet files by path below ``root``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = files.getRawFileSystem() if files.getScheme() == "file" else files  # without checksum files beside VERSIONS
    found: dict[str, tuple[int, int]] = {}
    if files.exists(top):
        base, each = files.makeQualified(top).toUri().getPath().rstrip("/"), files.listFiles(top, True)
        while each.hasNext():
            status = each.next()
            name = status.getPath().toUri().getPath()[len(base) + 1 :]
            if name.endswith(".parquet") and name.split("/")[0] in ("bars", "funding"):
                found[name] = (status.getLen(), status.getModificationTime())
    return files, found


def content_version(spark: SparkSession, root: str, keep: bool = True) -> str:
    """An id of what is in a lake: the same for a copy and for the same rows in other files or another order, another one once a value changes.

    The rows of a file come to their number and two sums of hashes, and files to the sums of these, so any order and any grouping of
    files gives the same. What files came to is kept in VERSIONS (with ``keep``), and only new or changed files are read again.
    """
    files, found = _files(spark, root)
    if not found:
        return "empty"
    at = spark._jvm.org.apache.hadoop.fs.Path(root, VERSIONS)
    known: dict[str, list] = {}
    if files.exists(at):
        stream = files.open(at)
        try:
            known = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            known = {}  # cut off by a crash: all is read again
        finally:
            stream.close()
    known = {name: v for name, v in known.items() if name in found and tuple(v[:2]) == found[name]}
    for table in ("bars", "funding"):
        new = [name for name in found if name not in known and name.split("/")[0] == table]
        if not new:
            continue
        rows = spark.read.option("basePath", f"{root}/{table}").parquet(*(f"{root}/{name}" for name in new))
        sums = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("n"), *(F.sum(_row_hash(rows, seed)).alias(f"h{seed}") for seed in (1, 2)))
        read = {unquote(r["_file"]): [int(r[c]) for c in ("n", "h1", "h2")] for r in sums.collect()}  # a row for each file that is new
        for name in new:
            known[name] = [*found[name], *next((v for file, v in read.items() if file.endswith(f"/{name}")), [0, 0, 0])]
    if keep:
        stream = files.create(at, True)
        try:
            stream.write(json.dumps(known).encode())
        finally:
            stream.close()
    total = {t: [sum(v[i] for name, v in known.items() if name.split("/")[0] == t) for i in (2, 3, 4)] for t in ("bars", "funding")}
    return hashlib.sha256(json.dumps(total, sort_keys=True).encode()).hexdigest()[:16]
