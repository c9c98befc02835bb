"""The results store: one typed row for each configuration, upserted by id.

A store is a folder of tables that are only added, and a log of numbered commits that say which of them count. A write adds
its own rows as a delta and commits it, so its cost follows the new rows, not the store. Readers merge: of equal ids the row of
the latest commit counts. When deltas pile up, compact() merges them into one table and commits that in their place.

A commit is a folder that is renamed to the next number of the log: of two writers that want the same number one succeeds, and
the other looks at the log again and takes the next. A crash before the rename leaves the store as it was. Everything goes
through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RUN_BOOLEANS, RUN_DOUBLES, RUN_LONGS, RUN_STRINGS, RUNS, RUNS_VERSION, finite, keep_last

COLUMNS = [f.name for f in RUNS.fields]
STATUSES = {"all", "verdict", "error", "screening"}


def is_error() -> Column:
    return F.trim(F.coalesce(F.col("error"), F.lit(""))) != ""


def normalize_runs(rows: DataFrame) -> DataFrame:
    """The store's columns and types. Unknown columns and missing or blank ids raise; failed rows are neither alive nor have trades."""
    unknown = [c for c in rows.columns if c not in COLUMNS]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    if "config_id" not in rows.columns:
        raise ValueError("rows lack config_id")
    own = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in own else F.lit("")
    long = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double").cast("long"), F.lit(0).cast("long")) if c in own else F.lit(0).cast("long")
    real = lambda c: finite(F.col(c).cast("string").try_cast("double")) if c in own else F.lit(None).cast("double")
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in own else F.lit(False)
    kinds = ((RUN_STRINGS, text), (RUN_LONGS, long), (RUN_DOUBLES, real), (RUN_BOOLEANS, true))
    out = rows.select(*(make(c).alias(c) for names, make in kinds for c in names))
    named = F.when(F.trim("config_id") != "", F.col("config_id")).otherwise(F.raise_error(F.lit("a row has no config_id")).cast("string"))
    out = out.withColumns({"config_id": named, "error": F.trim("error")})
    failed = F.col("error") != ""
    return out.withColumns(
        {"alive": F.col("alive") & ~failed & ~F.col("screening"), "trades": F.when(failed, 0).otherwise(F.col("trades")).cast("long"), "reasons": F.when(failed, "").otherwise(F.col("reasons"))}
    ).select(*COLUMNS)


def upsert(old: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """``old`` without the ids of ``new``, and ``new``, of equal ids the last by ``sequence``."""
    latest = keep_last(new, [key], sequence)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


#: Deltas beyond which a write compacts the store.
COMPACT_AFTER = 16
#: Numbers of rows inside a delta lie below this; a row's place in the store is its commit's number times this and its own.
ROWS = 1 << 42
#: Partitions of a delta, so that monotonically_increasing_id() stays below ROWS.
PARTS = 256
#: Seconds after which a table that no commit names is taken for the rest of a crash.
FORGOTTEN = 86_400
LOG = "_log"


class _Folder:
    """The store's folder in its own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop, self.conf, self.gateway = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path, self.root = path, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(self.conf)
        if self.files.getScheme() == "file":
            self.files = self.files.getRawFileSystem()  # no checksum files beside those of the log

    def at(self, *names: str):
        out = self.root
        for name in names:
            out = self.hadoop.fs.Path(out, name)
        return out

    def names(self, *below: str) -> list:
        return list(self.files.listStatus(self.at(*below))) if self.files.exists(self.at(*below)) else []

    def text(self, path) -> str:
        stream = self.files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commits_now(self) -> dict[int, dict] | None:
        """The log as listed, or None if a commit of the list was cleaned away meanwhile."""
        out: dict[int, dict] = {}
        for status in self.names(LOG):
            number = status.getPath().getName()
            if not number.isdigit():
                continue
            try:
                entry = next((x for x in self.files.listStatus(status.getPath()) if x.isFile() and x.getPath().getName().endswith(".json")), None)
                text = self.text(entry.getPath()) if entry is not None else None
            except Py4JJavaError:
                if self.files.exists(status.getPath()):
                    raise
                text = None
            if text is None:
                return None
            out[int(number)] = json.loads(text)
        return dict(sorted(out.items()))

    def commits(self) -> dict[int, dict]:
        """The log: each commit by its number. A commit that goes while the log is read was folded into one that the list may lack, so it is listed again."""
        for _ in range(100):
            if (found := self._commits_now()) is not None:
                return found
        raise OSError(f"the log of {self.path} does not come to rest")

    def commit(self, number: int, entry: dict) -> bool:
        """Make ``entry`` the commit of that number; False if there is one already."""
        token = uuid.uuid4().hex
        beside = self.at(LOG, f"new-{token}")
        stream = self.files.create(self.hadoop.fs.Path(beside, f"{token}.json"), False)
        try:
            stream.write(json.dumps(entry | {"version": RUNS_VERSION}).encode())
        finally:
            stream.close()
        to = self.at(LOG, f"{number:012d}")
        try:
            # A rename onto a folder that isn't empty fails, or where a file system puts the source inside, our file isn't at its place.
            self.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(beside, to, self.gateway.new_array(self.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if not self.files.exists(to):
                raise OSError(f"the store's log can't be written: {e}") from e
        done = self.files.exists(self.hadoop.fs.Path(to, f"{token}.json"))
        for left in (beside, self.hadoop.fs.Path(to, f"new-{token}")):
            if not done and self.files.exists(left):
                self.files.delete(left, True)
        return done

    def drop(self, *names: str) -> None:
        self.files.delete(self.at(*names), True)


def tables_of(commits: dict[int, dict]) -> dict[str, int]:
    """The tables that count after ``commits``, with the number that goes before their rows' own: 0 for compacted ones, whose rows have theirs."""
    out: dict[str, int] = {}
    for number, entry in commits.items():
        for name in entry.get("remove", []):
            out.pop(name, None)
        out |= {name: number for name in entry.get("add", [])} | {name: 0 for name in entry.get("merged", [])}
    return out


def _log(folder: _Folder) -> dict[int, dict]:
    commits = folder.commits()
    for entry in commits.values():
        if entry["version"].split(".")[0] != RUNS_VERSION.split(".")[0]:
            raise ValueError(f"store version {entry['version']!r}, expected {RUNS_VERSION}")
    return commits


def _merged(spark: SparkSession, path: str, tables: dict[str, int]) -> DataFrame:
    """Of equal ids in ``tables`` the latest row, with its place ``seq``."""
    rows = spark.read.parquet(*(f"{path}/{name}" for name in tables))
    of = F.regexp_extract(F.col("_metadata.file_path"), r"/((?:delta|merged)-[0-9a-f]{32})/[^/]*$", 1)
    numbers = F.create_map(*(F.lit(x) for name, n in tables.items() for x in (name, n)))
    placed = rows.select(*COLUMNS, (F.element_at(numbers, of) * F.lit(ROWS) + F.col("_row")).alias("seq"))
    return keep_last(placed, ["config_id"], "seq").select(*COLUMNS, "seq")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their write order ``seq``; an absent store is empty, one of another major version is refused."""
    tables = tables_of(_log(_Folder(spark, path)))
    if not tables:
        return spark.createDataFrame([], RUNS).withColumn("seq", F.lit(0).cast("long"))
    return _merged(spark, path, tables)


def write_runs(rows: DataFrame, path: str) -> None:
    """Upsert; any number of writers may do so at once, and the one whose commit is later wins an id. Reads and writes only its own rows."""
    spark, folder, name = rows.sparkSession, _Folder(rows.sparkSession, path), f"delta-{uuid.uuid4().hex}"
    commits = _log(folder)
    normalize_runs(rows).coalesce(PARTS).withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{path}/{name}")
    number = max(commits, default=0) + 1
    while not folder.commit(number, {"add": [name]}):
        number = max(folder.commits(), default=number) + 1
    if len(tables_of(folder.commits())) > COMPACT_AFTER:
        compact(spark, path)


def compact(spark: SparkSession, path: str) -> bool:
    """Merge the store's tables into one; False if another did so meanwhile. Tables that the compaction before took the place of are
    deleted now, so whoever reads through one compaction still finds what they read."""
    folder = _Folder(spark, path)
    tables, name = tables_of(_log(folder)), f"merged-{uuid.uuid4().hex}"
    if not tables:
        return False
    replaced = lambda commits: not set(tables) <= set(tables_of(commits))  # noqa: E731  by another compaction
    try:
        _merged(spark, path, tables).withColumnRenamed("seq", "_row").write.parquet(f"{path}/{name}")
    except Exception:
        if not replaced(folder.commits()):
            raise
    while True:
        commits = folder.commits()
        if replaced(commits):
            folder.drop(name)
            return False
        if folder.commit(max(commits) + 1, {"merged": [name], "remove": sorted(tables)}):
            break
    _clean(folder, commits)
    return True


def _clean(folder: _Folder, before: dict[int, dict]) -> None:
    """Delete what commits up to the compaction before the last have removed, tables that no commit ever named, and commits that say nothing any more."""
    now = folder.commits()
    live = tables_of(now)
    gone = {name for entry in before.values() for name in entry.get("remove", [])}
    named = {name for entry in now.values() for name in (*entry.get("add", []), *entry.get("merged", []))}
    for status in folder.names():
        name, age = status.getPath().getName(), time.time() - status.getModificationTime() / 1000
        if name in gone or (name.startswith(("delta-", "merged-")) and name not in named and age > FORGOTTEN):
            folder.drop(name)
    compactions = [n for n, entry in before.items() if entry.get("merged")]
    for n, entry in before.items():
        if n < max(compactions, default=0) and not any(name in live or name not in gone for name in (*entry.get("add", []), *entry.get("merged", []))):
            folder.drop(LOG, f"{n:012d}")


def completed_ids(runs: DataFrame, data_version: str, screening: bool) -> DataFrame:
    """Ids that need no new run: same data, no error; screened rows count for screening runs only."""
    done = runs.where((F.col("data_version") == data_version) & ~is_error())
    return (done if screening else done.where(~F.coalesce("screening", F.lit(False)))).select("config_id").distinct()


def _status(status: str) -> Column:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(sorted(STATUSES))}")
    return {"all": F.lit(True), "error": is_error(), "verdict": ~is_error(), "screening": ~is_error() & F.coalesce("screening", F.lit(False))}[status]


def query_runs(
    runs: DataFrame, symbol: str | None = None, timeframe: str | None = None, alive: bool | None = None, status: str = "all", order: str | None = None,
    descending: bool = True, limit: int | None = None, tie: str = "config_id",
) -> DataFrame:
    """Filtered, sorted with nulls last, and limited."""
    found = runs.where(_status(status))
    for column, value in (("symbol", symbol), ("timeframe", timeframe), ("alive", alive)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if order:
        found = found.orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), tie)
    return found.limit(limit) if limit is not None else found


def group_counts(runs: DataFrame, column: str, status: str = "all") -> DataFrame:
    return runs.where(_status(status)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
