"""Importance resampling towards a target distribution, over an integer word dictionary.

A block of texts gets a dictionary of its words; n-grams are tuples of word ids, packed into one integer; each distinct
tuple of the block is spelled out and hashed once, and its bucket is joined back to its occurrences by position. Blocks
are made inside tasks, so a dictionary never grows with the corpus, and the buckets of every text are written, so that
nothing is hashed again when weights are known.

A bucket's gain compares its share in the target with that in the corpus, a document's weight is the mean gain of its
features, and those with the highest sum of weight and seeded Gumbel noise are drawn: sampling without replacement.
Ranks come from counts of scores in three levels, so no task orders all documents.

Defined results: a null or empty text has no words and no features, its weight is 0 and it is never drawn; a null id is
hashed as nothing and orders last; rows with equal ids and texts are documents of their own with ranks one after the other;
texts are read whole, whatever their length; only the id and the text are read, so other columns can't clash; an empty
table gives an empty result, and an empty target gives gains from the corpus alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

#: What separates words once A to Z are lower-cased: every other character below U+0080 that is no letter or digit.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Code units of text in a block, unless one text alone has more.
BLOCK = 8 << 20
#: Width of the coarse cells in which scores are counted first.
CELL = 1024


def blocks_of(texts: pa.Array, most: int = BLOCK) -> Iterator[pa.Array]:
    """Slices of ``texts`` of at most ``most`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def words_of_block(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The dictionary of a block, the ids of all its words in order, and the number of words of each text."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    coded = pieces.flatten().dictionary_encode()
    ids, owner = coded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    nothing = pc.index(coded.dictionary, "").as_py()  # before a leading separator and after a trailing one
    if nothing >= 0:
        real = ids != nothing
        ids, owner = ids[real], owner[real]
    return coded.dictionary, ids.astype(np.int64), np.bincount(owner, minlength=len(texts))


def hashed(strings: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, strings.cast(pa.binary()).to_pylist()), dtype=np.uint32, count=len(strings)) % buckets


def feature_buckets(texts: pa.Array, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, features of each text, and the buckets of all features, text after text: runs of one word first."""
    words, ids, n_words = words_of_block(texts)
    starts = np.cumsum(n_words) - n_words
    at = np.arange(len(ids)) - np.repeat(starts, n_words)  # place of a word in its text
    left = np.repeat(n_words, n_words) - at
    sizes = sum((np.maximum(n_words - k, 0) for k in range(width)), np.zeros(len(n_words), dtype=np.int64))
    first, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), dtype=np.uint16)
    codes, spelled = ids, words  # the runs of k + 1 words: their codes by first word, and what each code stands for
    for k in range(width):
        begins = np.flatnonzero(left > k)
        if k:
            # A run is the code of the run one shorter that begins with it, and the id of its last word.
            pairs, codes_of = np.unique(codes[begins] * len(words) + ids[begins + k], return_inverse=True)
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), " ")
            codes = np.full(len(ids), -1, dtype=np.int64)
            codes[begins] = codes_of
        runs = np.maximum(n_words - k, 0)
        out[np.repeat(first, runs) + at[begins]] = hashed(spelled, buckets)[codes[begins]]
        first = first + runs
    return n_words, sizes, out


def features(docs: DataFrame, width: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of ``docs`` (doc_id, text): two bytes for each occurrence of a feature."""
    if not 0 < buckets <= 1 << 16 or width < 1:
        raise ValueError("buckets: 1 to 65536; width: 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in blocks_of(batch["text"]):
                n_words, sizes, found = feature_buckets(texts, width, buckets)
                ends = np.concatenate([[0], np.cumsum(2 * sizes)])
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found)])
                ids = batch["doc_id"].slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(sizes, pa.int64()), stored.cast(pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])
                done += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _found(stored: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where each row's end."""
    if not len(stored):
        return np.empty(0, dtype=np.uint16), np.empty(0, dtype=np.int64)
    lengths = pc.binary_length(stored).to_numpy(zero_copy_only=False) // 2
    offsets = np.frombuffer(stored.buffers()[1], dtype=np.int32)[stored.offset : stored.offset + len(stored) + 1]
    data = stored.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint16, count=int(offsets[-1] - offsets[0]) // 2, offset=int(offsets[0])) if data is not None else np.empty(0, dtype=np.uint16)
    return values, np.cumsum(lengths)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features each bucket holds; one count for each bucket leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_found(batch["buckets"])[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: a thousand times the logarithm of its smoothed share in ``target`` over that in ``corpus``, floored."""
    spark = corpus.sparkSession
    each = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row each
    share = lambda n, total: (F.col(n) + 1).cast("double") * (F.col(total) + buckets)
    return each.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(share("t", "all_s") / share("s", "all_t"))).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, width: int = 2, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text); ``target`` has text."""
    rows = materialize(features(docs, width, buckets), "features")
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), width, buckets)
    found = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets), buckets).collect()  # as many rows as buckets
    gain = np.zeros(buckets, dtype=np.int64)
    gain[[r["bucket"] for r in found]] = [r["gain"] for r in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _found(batch["buckets"])
            upto = np.concatenate([[0], np.cumsum(gain[values])])
            ends = np.concatenate([[0], ends])
            n = np.diff(ends)
            weight = np.where(n > 0, (upto[ends[1:]] - upto[ends[:-1]]) // np.maximum(n, 1), 0)  # rounds down
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], batch["n_features"], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(scored: DataFrame, least_words: int = 20, percent: int = 25) -> DataFrame:
    """``scored`` with ``rank``, 1 for the highest score, of the ``percent`` of documents of ``least_words`` words that are drawn; null for the others.

    Rows that are equal in every column are counted first. What stands before a score is the sum over coarse cells of scores,
    scores inside the cell and ids inside the score; a cell holds at most CELL scores, so no window sees more than a score's ids.
    """
    own = ["doc_id", "n_words", "n_features", "weight", "score"]
    alike = scored.where(F.col("n_words") >= least_words).groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_cell", F.expr(f"floor(score / {CELL})"))
    of_score = alike.groupBy("_cell", "score").agg(F.sum("_n").alias("_s"))
    of_cell = of_score.groupBy("_cell").agg(F.sum("_s").alias("_c"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, w: F.coalesce(F.sum(n).over(upto(w)), F.lit(0))
    cells = of_cell.select("_cell", before("_c", Window.orderBy(F.desc("_cell"))).alias("_cells"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_all"))  # a row for each cell of scores
    places = of_score.select("_cell", "score", before("_s", Window.partitionBy("_cell").orderBy(F.desc("score"))).alias("_scores")).join(F.broadcast(cells), "_cell")
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_words", "n_features", "weight")
    placed = alike.withColumn("_ids", before("_n", inside)).join(places.drop("_cell"), "score")
    first = placed.select(*own, "_n", "_all", (F.col("_cells") + F.col("_scores") + F.col("_ids") + 1).alias("_first"))
    chunk = 4096
    spread = first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {chunk}"))).alias("_k"))
    copies = F.sequence(F.col("_k") * chunk, F.least((F.col("_k") + 1) * chunk, F.col("_n")) - 1)
    each = spread.select(*own, "_all", "_first", F.explode(copies).alias("_copy")).withColumn("rank", F.col("_first") + F.col("_copy"))
    drawn = each.select(*own, F.when(F.col("rank") <= F.expr(f"_all * {percent} div 100"), F.col("rank")).alias("rank"))
    short = scored.where(~(F.col("n_words") >= least_words)).select(*own, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(short)


def resample(docs: DataFrame, target: DataFrame, least_words: int = 20, percent: int = 25, **options) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, rank null for those that are not drawn."""
    return ranked(materialize(scores(docs, target, **options), "scores"), least_words, percent)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, in their own columns; rows that share an id go together."""
    ids = resample(docs.select("doc_id", "text"), target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
