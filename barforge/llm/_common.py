"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: White space that separates words: U+0020 and U+0009 to U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    A column that a higher-order function captures is otherwise evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than SPACE."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session, where all tasks share one machine, gets one of its own if it names none."""
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


#: Folders that materialize() has written and discard() has not removed.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)  # snappy would hold buffers outside the heap for each of many small files
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of materialize() once nothing reads them any more."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in paths:
        if path in _written:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
            _written.remove(path)


#: Bytes that a broadcast table has at most, whatever its number of rows.
BROADCAST_BYTES = 128 << 20


def _width(value: Column, kind: DataType) -> Column:
    """Bytes of a value, roughly: whole strings, 8 for a number."""
    if isinstance(kind, (StringType, BinaryType)):
        each = F.octet_length(value)
    elif isinstance(kind, StructType):
        each = sum((_width(value[f.name], f.dataType) for f in kind), F.lit(8))
    elif isinstance(kind, ArrayType):
        nested = isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType))
        each = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + 8 + _width(x, kind.elementType)) if nested else 8 * F.size(value)
    else:
        return F.lit(8).cast("long")
    return F.coalesce(each, F.lit(0)).cast("long")


def maybe_broadcast(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a materialized table of at most ``most_rows`` rows and ``most_bytes`` bytes; leave the join of others to the planner."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    rows, size = df.limit(most_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= most_bytes else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each stem."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """Whole rows as ``row`` beside the columns an operator reads: no name of theirs can clash with its own."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(c) for c in needed))


def unpacked(df: DataFrame, columns: list[str], *results: str) -> DataFrame:
    """``columns`` of the packed rows with ``results`` added; a column that has the name of a result is replaced by it."""
    new = {r.lower() for r in results}
    return df.select(*(F.col("row")[c].alias(c) for c in columns if c.lower() not in new), *results)
