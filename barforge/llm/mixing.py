"""Mixing sources to target weights.

Each source's words are laid out in one stream (documents in seeded order) and packed into blocks of fixed length.
Output shards draw their numbers of blocks from the sources as a multinomial draw whose totals over all shards are held
to the targets. The k-th slot of a source takes the block at the k-th place of a pseudorandom permutation of the
source's block indexes, beginning again after the last, so a block is used as often as any other of its source, or once
more; slots and blocks are then joined by index.

Streams are laid out by prefix sums in two levels (seeded bucket, then document), so no source has to fit in one task.
Per-source figures are held on the driver: sources must number at most ``most_sources``, which is checked. Shards are drawn
in two levels, groups on the driver and shards in tasks, so their number is not bounded by it.

Defined results: a document without words is never taken; a null source is a source, the last one; rows that are equal
take a place each in the stream; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ._common import SPACE, materialize, text_of

#: Weights of the sources by code point, repeated.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE, -1))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """``share`` of all sizes dealt out by weight; none above ``most`` times its size, the excess dealt again."""
    total, out, fixed = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(out[i] for i in fixed)
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in open_)
        if not open_ or not weight:
            return out
        for i in open_:
            out[i] = rest * weights[i] / weight
        above = [i for i in open_ if out[i] > most * sizes[i]]
        if not above:
            return out
        for i in above:
            out[i] = float(most * sizes[i])
            fixed.add(i)


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def plan_sources(sized: DataFrame, block_words: int, most_sources: int = 100_000) -> list[Source]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [r["size"] for r in rows]
    aims = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(rows))])
    blocks = [-(-n // block_words) for n in sizes]
    return [Source(r["source"], n, t, b, min(round(t / block_words), 2 * b)) for r, n, t, b in zip(rows, sizes, aims, blocks, strict=True)]


def draw_shards(slots: list[int], shards: int, seed: int | list[int], each: list[int] | None = None) -> np.ndarray:
    """(shards, sources): multinomial draws of almost equal shards, or of sizes as ``each``, that add up to ``slots``."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    share = each or [1] * shards
    ahead = np.cumsum(share[::-1])[::-1].tolist()
    for k in range(shards):
        want = int(left.sum()) * share[k] // ahead[k]
        got = np.minimum(rng.multinomial(want, left / left.sum()), left) if want else np.zeros_like(left)
        while (short := want - int(got.sum())) > 0:  # draws beyond what a source has left go to the others
            spare = left - got
            got += np.minimum(rng.multinomial(short, spare / spare.sum()), spare)
        out[k], left = got, left - got
    return out


def shard_runs(spark: SparkSession, sources: list[Source], shards: int, seed: int, most_groups: int = 1024) -> DataFrame:
    """(shard, source_id, n, first, slot0, blocks): how many slots of a source a shard has, from which on in the source and in the shard.

    The driver draws for groups of shards only, ``most_groups`` at most; each group's task draws its own shards from what the group has.
    """
    groups = max(1, min(shards, most_groups, 2_000_000 // max(1, len(sources))))
    each = [(g + 1) * shards // groups - g * shards // groups for g in range(groups)]
    draws = draw_shards([s.slots for s in sources], groups, seed, each)
    first = np.cumsum(draws, axis=0) - draws
    start = np.cumsum([0, *each[:-1]])
    rows = [(g, int(start[g]), each[g], draws[g].tolist(), first[g].tolist()) for g in range(groups)]
    blocks = [s.blocks for s in sources]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = draw_shards(list(row.slots), row.shards, [seed, row.number])
                k, i = np.nonzero(own)
                yield pd.DataFrame(
                    {"shard": k + row.start, "source_id": i, "n": own[k, i], "first": (np.cumsum(own, axis=0) - own + np.array(row.first))[k, i],
                     "slot0": (np.cumsum(own, axis=1) - own)[k, i], "blocks": np.array(blocks, dtype=np.int64)[i]}
                )

    table = spark.createDataFrame(rows, "number int, start long, shards int, slots array<bigint>, first array<bigint>").repartition(groups, "number")
    return table.mapInPandas(run, "shard int, source_id int, n long, first long, slot0 long, blocks long")


def _mixed(x: np.ndarray, key: int, most: np.ndarray) -> np.ndarray:
    """A hash of ``x`` below ``most`` (the finalizer of splitmix64)."""
    z = x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) % most.astype(np.uint64)


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) takes ``index``: a Feistel network on a rectangle, walked until inside."""
    high = np.ceil(np.sqrt(n)).astype(np.int64)
    low = -(-n // high)
    at, todo = index.astype(np.int64).copy(), np.ones(len(index), dtype=bool)
    while todo.any():
        h, w = high[todo], low[todo]
        a, b, k = at[todo] // w, at[todo] % w, key[todo].astype(np.uint64) << np.uint64(32)
        for r in range(rounds):
            a = (a + _mixed(b.astype(np.uint64) ^ k, 2 * r, h).astype(np.int64)) % h
            b = (b + _mixed(a.astype(np.uint64) ^ k, 2 * r + 1, w).astype(np.int64)) % w
        at[todo] = a * w + b
        todo[todo] = at[todo] >= n[todo]
    return at


def stream_offsets(sized: DataFrame, seed: int, bucket_docs: int = 20_000) -> DataFrame:
    """``sized`` (with source, size and a hash _x of the text) with ``offset``: where a document begins in its source's stream."""
    buckets = max(64, -(-sized.count() // bucket_docs))
    placed = sized.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_x"))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = materialize(placed.groupBy("source", "_b").agg(F.sum("size").alias("n")), "bucket-sums")
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "_x", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    return joined.withColumn("offset", F.col("_first") + F.col("_within")).drop("_h", "_x", "_b", "_s", "_sb", "_first", "_within")


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 16_384, seed: int = 41) -> tuple[DataFrame, DataFrame]:
    """The documents with their place (all columns but text, size, source_size, target, source_id, offset), and the mix:
    (shard, slot, source_id, block, offset, begin, end), words begin to end of the document at ``offset`` in each slot's block."""
    spark = docs.sparkSession
    sized = materialize(docs.withColumns({"size": n_words(text_of()), "_x": F.xxhash64(text_of())}).drop("text"), "sizes")
    sources = plan_sources(sized, block_words)
    schema = "source_id int, _name string, source_size long, target double, blocks long"
    table = spark.createDataFrame([(i, s.name, s.size, s.target, s.blocks) for i, s in enumerate(sources)], schema)
    placed = stream_offsets(sized, seed).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "blocks")  # at most most_sources rows
    placed = materialize(placed, "streams")
    runs = shard_runs(spark, sources, max(1, math.ceil(sum(s.slots for s in sources) / shard_slots)), seed)

    @pandas_udf("long")
    def block_at(k: pd.Series, n: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series(permute((k % n).to_numpy(), n.to_numpy(), source.to_numpy() + seed * 1_000_003))

    slots = runs.select("shard", "source_id", "first", "slot0", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    slots = slots.select("shard", "source_id", (F.col("slot0") + F.col("i")).alias("slot"), block_at(F.col("first") + F.col("i"), "blocks", "source_id").alias("block"))
    size = F.lit(block_words).cast("long")
    pieces = placed.where(F.col("size") > 0).select(
        "source_id", "offset", "size", F.explode(F.sequence(F.expr(f"offset div {block_words}"), F.expr(f"(offset + size - 1) div {block_words}"))).alias("block")
    )
    begin = F.greatest(F.col("block") * size, F.col("offset")) - F.col("offset")
    end = F.least((F.col("block") + 1) * size, F.col("offset") + F.col("size")) - F.col("offset")
    pieces = pieces.select("source_id", "offset", "block", begin.alias("begin"), end.alias("end"))
    # Both sides grow with the corpus, but the planner takes exploded slots for as small as the table of runs.
    return placed, slots.join(pieces.hint("merge"), ["source_id", "block"]).select("shard", "slot", "source_id", "block", "offset", "begin", "end")


def taken_words(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """``placed`` with ``taken``: how many words of each document the mix takes, repeats counted."""
    taken = mixed.groupBy(F.col("source_id").alias("_i"), F.col("offset").alias("_o")).agg(F.sum(F.col("end") - F.col("begin")).alias("_t"))
    joined = placed.join(taken, (F.col("source_id") == F.col("_i")) & (F.col("offset") == F.col("_o")) & (F.col("size") > 0), "left")
    return joined.withColumn("taken", F.coalesce("_t", F.lit(0)).cast("long")).drop("_i", "_o", "_t")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, each as often as the mix uses the block in which its words begin; the columns are those of ``docs``.

    A document without words begins no block of its own and is left out, as the mix takes nothing of it.
    """
    rows = docs.select(F.xxhash64(*docs.columns).alias("_row"), F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    placed, mixed = mix(rows.select("_row", "doc_id", "source", "text"), **options)
    block = options.get("block_words", 64)
    first = mixed.where((F.col("begin") == 0) & (F.expr(f"offset div {block}") == F.col("block")))
    uses = first.groupBy(F.col("source_id").alias("_i"), F.col("offset").alias("_o")).agg(F.count("*").alias("_uses"))
    times = placed.join(uses, (F.col("source_id") == F.col("_i")) & (F.col("offset") == F.col("_o")) & (F.col("size") > 0))
    # Rows that are equal in every column take places of their own; together they appear as often as these places are used.
    times = times.groupBy(F.col("_row").alias("_t")).agg(F.sum("_uses").alias("_n"))
    joined = rows.select("_row", "row").join(times, F.col("_row") == F.col("_t"))
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(0)))
    share = F.expr("_n div _rows + if(_rank <= _n % _rows, 1, 0)")
    whole = joined.withColumns({"_rank": rank, "_rows": F.count("*").over(Window.partitionBy("_row"))}).withColumn("_share", share.cast("int")).where("_share > 0")
    return whole.select("row", F.explode(F.sequence(F.lit(1), F.col("_share"))).alias("_again")).select("row.*")
