"""Two-pass external shuffle into shards.

First pass: each record is scattered by a seeded hash, first to a shard (highest random weight of its key, so one more
shard takes rows only into itself), then to a bucket of that shard small enough for memory. Second pass: the records of
a bucket are gathered, put in a fixed order and dealt out by a Fisher-Yates shuffle whose draws are seeded hashes, so a
record's slot depends on seed and data alone, not on partitions. It is the bucket's offset plus the place; offsets come
from a count of the same hashes.

Buckets depend on the whole row, so neither a hot source nor a group of copies meets in one of them. Rows equal in every
column are counted before anything is shuffled and fill one bucket after another, each up to its size.

Defined results: a null text has no bytes and the CRC of no bytes (0); null keys hash alike; equal rows get a slot each;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fresh, materialize, maybe_broadcast

#: Bytes of a record besides its text.
RECORD_BYTES = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def rendezvous_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest weight for ``key``."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("w"), s.alias("s")))
    return F.array_max(weights)["s"].cast("int")


def fisher_yates(n: Column, seed: Column) -> Column:
    """The numbers below ``n`` as a Fisher-Yates shuffle leaves them. Its draws are hashes of ``seed`` and the step, so seed and size alone decide."""

    def swap(dealt: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        return F.transform(dealt, lambda x, k: F.when(k == i, F.get(dealt, j)).when(k == j, F.get(dealt, i)).otherwise(x))

    last = (n - 1).cast("int")
    steps = F.when(last > 0, F.sequence(last, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), last), swap)


def external_shuffle(
    docs: DataFrame, shards: int = 40, seed: int = 20240229, bucket_bytes: int = 16 << 20, bucket_rows: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with shard, grown_shard (with one more shard) and slot (gapless from 0 in each shard).

    Buckets hold about ``bucket_bytes`` and ``bucket_rows`` at most, on average; a swap walks its bucket's numbers, so buckets are kept short.
    """
    own = docs.columns
    shard, grown, bucket, slot, rows, first, mark, most, copies, part = fresh(
        docs, "shard", "grown_shard", "_bucket", "slot", "_rows", "_first", "_mark", "_most", "_copies", "_part"
    )
    ordered = [F.col(c) for c in [key, *(c for c in own if c != key)]]
    size = record_size(F.col(text))
    placed = docs.withColumns({shard: rendezvous_shard(F.col(key), shards, seed), mark: F.xxhash64(F.lit(seed + 1), *ordered)}).withColumn(
        most, F.greatest(F.lit(1), F.least(F.lit(bucket_rows), F.floor(F.lit(bucket_bytes) / size)))
    )
    which = [shard, mark, most]
    marks = materialize(placed.groupBy(*which).agg(F.count("*").alias(copies), F.sum(size).alias("_bytes")), "marks")
    largest = marks.groupBy(shard).agg(F.sum("_bytes").alias("b"), F.sum(copies).alias("n")).agg(F.max("b"), F.max("n")).first()
    buckets = max(1, -(-(largest[0] or 0) // bucket_bytes), -(-(largest[1] or 0) // bucket_rows))
    to_bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(mark), F.col(part)), F.lit(buckets)).alias(bucket)

    record = F.struct(*ordered).alias("_record")
    once = placed.withColumn(part, F.lit(0).cast("long"))
    counts = marks.where(F.col(copies) <= F.col(most)).withColumn(part, F.lit(0).cast("long")).select(shard, to_bucket, copies)
    often = marks.where(F.col(copies) > F.col(most)).select(*which)
    if often.isEmpty():
        scattered = once.select(shard, to_bucket, record)
    else:  # repeated rows travel as a row and a number, and become rows again in as many buckets as they fill
        often = maybe_broadcast(often, 500_000)
        counted = placed.join(often, which, "left_semi").groupBy(*which, *own).agg(F.count("*").alias(copies))
        split = materialize(counted, "repeated-rows").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / F.col(most)))))
        split = split.select(shard, to_bucket, F.least(F.col(most), F.col(copies) - F.col(part) * F.col(most)).alias(copies), record)
        counts = counts.unionByName(split.drop("_record"))
        again = split.select(shard, bucket, "_record", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop("col")
        scattered = once.join(often, which, "left_anti").select(shard, to_bucket, record).unionByName(again)

    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.groupBy(shard, bucket).agg(F.sum(copies).alias("n")), "offsets").select(
        F.col(shard).alias("_s"), F.col(bucket).alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)
    )
    gathered = scattered.groupBy(shard, bucket).agg(F.sort_array(F.collect_list("_record")).alias(rows))
    dealt = gathered.withColumn(slot, fisher_yates(F.size(rows), F.xxhash64(F.lit(seed + 2), F.col(shard), F.col(bucket))))
    joined = dealt.join(offsets, (F.col(shard) == F.col("_s")) & (F.col(bucket) == F.col("_b")))
    each = joined.select(shard, first, F.explode(F.arrays_zip(F.col(rows).alias("r"), F.col(slot).alias("k"))).alias("e"))
    return each.select(*(F.col("e.r")[c].alias(c) for c in own), F.col(shard), (F.col(first) + F.col("e.k")).cast("long").alias(slot)).withColumn(
        grown, rendezvous_shard(F.col(key), shards + 1, seed)
    )
