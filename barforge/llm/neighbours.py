"""Nearest neighbours by few stable projections, a kd-tree over them, and a chi-square stopping test.

Unit vectors are projected on ``m`` seeded Gaussian directions. As the normal law is 2-stable, the squared projected distance
of two vectors over their squared distance follows chi-square with m degrees of freedom. A query takes its projected
neighbours nearest first and verifies them on the whole vectors; it stops once the next projected distance r and the best
distance d so far satisfy P(chi2_m <= r * r / (d * d)) >= ``sure``: then each row nearer than d would have been met
with that probability. Squared distance of unit vectors is 2 - 2 cos, so the nearest have the largest cosine.

On a cluster the tree has two levels. Its upper cells are medians of a sample of at most ``sample`` projected vectors (the
rows with the smallest hashes); every row goes to a cell, and a cell of more than ``block`` rows is dealt into blocks by hash. A
query first searches one block of its own cell for a bound, then every block of the cells that its radius reaches; inside a
block a kd-tree of its own gives the projected neighbours leaf by leaf. Queries travel in chunks, so a task holds one block
and one chunk, whatever the table's size. All rows are indexed and no list of candidates is cut off.

Rows of equal vectors are one entry with its k + 1 smallest ids: all others would come after these in every result.

Defined results: rows whose id is null or whose vector is null, empty, zero or holds null or non-finite components take no part.
Vectors of different length are not compared. Equal rows of a query are one query, and all of them but one are candidates.
Ties go to the smaller id. Other columns are not read, so they can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

@dataclass(frozen=True)
class Plan:
    """Parameters of the search. ``sure`` is the stopping test's probability, a bound of the recall that is to be expected."""

    k: int = 5
    m: int = 8
    sure: float = 0.95
    sample: int = 16_384
    block: int = 4_096
    chunk: int = 2_048
    leaf: int = 128
    most_cells: int = 2_048
    seed: int = 11

    def __post_init__(self):
        if self.m % 2:
            raise ValueError("m must be even: the test uses the closed form of the law")


def chi_square(x: np.ndarray | float, m: int) -> np.ndarray:
    """P(chi2_m <= x) for even ``m``."""
    half = np.asarray(x, dtype="float64") / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(dims: int, plan: Plan) -> np.ndarray:
    """A Gaussian direction for each projection; the same for all tasks."""
    return np.random.default_rng([plan.seed, dims]).standard_normal((dims, plan.m))


class Tree:
    """A kd-tree of points: split at the median of the widest dimension until a leaf has at most ``most`` of them.

    Points that are equal in every dimension share a leaf. Cells of a tree made from a sample also tell where other points belong.
    """

    def __init__(self, points: np.ndarray, most: int):
        self.splits: dict[int, tuple[int, float]] = {}
        self.leaves: list[np.ndarray] = []
        self.number: dict[int, int] = {}
        todo = [(1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            low, high = (points[rows].min(axis=0), points[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            axis = int((high - low).argmax())
            if len(rows) <= most or high[axis] == low[axis]:
                self.number[node] = len(self.leaves)
                self.leaves.append(rows)
                continue
            cut = float(np.median(points[rows, axis]))
            left = points[rows, axis] < cut
            if not left.any():  # more than half of them lie at the least value
                left = points[rows, axis] <= cut
                cut = float(np.nextafter(cut, np.inf))
            self.splits[node] = (axis, cut)
            todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf that each point belongs to."""
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node in self.number:
                out[rows] = self.number[node]
            elif len(rows):
                axis, cut = self.splits[node]
                left = points[rows, axis] < cut
                todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        return out

    def boxes(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the cells, by the splits alone: they hold for any point of a cell."""
        low, high = np.full((len(self.leaves), m), -np.inf), np.full((len(self.leaves), m), np.inf)
        for node, at in self.number.items():
            child = node
            while child > 1:
                parent = child // 2
                axis, cut = self.splits[parent]
                if child % 2:
                    low[at, axis] = max(low[at, axis], cut)
                else:
                    high[at, axis] = min(high[at, axis], cut)
                child = parent
        return low, high


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j, None]
        out += np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0) ** 2
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)) if len(lists) else np.empty((0, 0))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, by sums that don't depend on a row's place."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


#: How far the product of two unit vectors may be from their cosine, generously.
SLACK = 1e-9


class Best:
    """The best rows of each query so far: one row for each place, by cosine and then id."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.query, self.entry, self.id, self.score = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64))
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, entry: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, entry, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.entry, entry), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, query))
        query, entry, ids, score = query[order], entry[order], ids[order], score[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = place < self.keep
        self.query, self.entry, self.id, self.score = query[kept], entry[kept], ids[kept], score[kept]
        full = self.query[place[kept] == self.keep - 1]
        self.least[full] = self.score[place[kept] == self.keep - 1]


def search_block(plan: Plan, units: np.ndarray, vectors: np.ndarray, id_lists: pa.Array, q_units: np.ndarray, q_vectors: np.ndarray, bound: np.ndarray) -> Best:
    """The best k + 1 rows of a block for each query. ``bound`` holds cosines that a query has k + 1 times elsewhere, or -inf.

    All queries take their next nearest leaf of the block's tree at once, so a leaf is verified against a matrix of them.
    """
    limit, g = chi_square_quantile(plan.sure, plan.m), directions(units.shape[1], plan)
    points, asked = units @ g, q_units @ g
    tree = Tree(points, plan.leaf)
    low, high = (np.array([f(points[rows], axis=0) for rows in tree.leaves]) for f in (np.min, np.max))
    reach = box_distance(asked, low, high)
    order = np.argsort(reach, axis=1, kind="stable")
    lengths, ids = id_lists.value_lengths().to_numpy(zero_copy_only=False), id_lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(lengths) - lengths
    best, active = Best(len(asked), plan.k + 1), np.arange(len(asked))
    for step in range(len(tree.leaves)):
        leaf = order[active, step]
        # The stopping test: with d the distance of the k + 1-th best, P(chi2 <= r^2 / d^2) >= sure.
        apart = np.maximum(2 - 2 * np.maximum(best.least, bound)[active], 0.0)
        going = reach[active, leaf] <= limit * np.where(np.isfinite(apart), apart, np.inf) + SLACK
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        found_q, found_e = [], []
        for at in np.unique(leaf):
            asks, rows = active[leaf == at], tree.leaves[at]
            near = q_units[asks] @ units[rows].T >= (np.maximum(best.least, bound)[asks] - SLACK)[:, None]
            q, e = np.nonzero(near)
            found_q.append(asks[q])
            found_e.append(rows[e])
        q, e = np.concatenate(found_q), np.concatenate(found_e)
        score = cosines(q_vectors[q], vectors[e])
        times = lengths[e]
        each = np.repeat(first[e], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        best.add(np.repeat(q, times), np.repeat(e, times), ids[each], np.repeat(score, times))
    return best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, raw) of the rows of ``vectors`` (vec_id, embedding) that take part."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  false for NaN too
    ok = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double") + 0.0).alias("raw"))


def scaled(rows: DataFrame) -> DataFrame:
    """``rows`` (raw) with dims, unit and v instead. v is raw times a power of two, which changes no cosine, so that squares
    of its components neither overflow nor vanish."""
    e = F.floor(F.log2(F.array_max(F.transform("raw", F.abs))) / 2).cast("double")
    wide = rows.withColumn("_p", F.pow(F.lit(2.0), -e)).withColumn("v", F.transform("raw", lambda c: c * F.col("_p") * F.col("_p")))
    wide = wide.withColumn("_norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))
    return wide.withColumns({"dims": F.size("v"), "unit": F.transform("v", lambda c: c / F.col("_norm"))}).drop("raw", "_p", "_norm")


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(h, ids, dims, v, unit): one row for each distinct vector that takes part, with its k + 1 smallest ids."""
    rows = usable(vectors).withColumn("h", F.xxhash64("raw"))
    place = F.row_number().over(Window.partitionBy("h", "raw").orderBy("vec_id"))
    few = rows.withColumn("_place", place).where(F.col("_place") <= k + 1)  # cut before the shuffle as well
    return scaled(few.groupBy("h", "raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _by_length(batch: pa.RecordBatch, plan: Plan, most: int = 1_024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their projections), some rows at a time."""
    dims = batch["dims"].to_numpy()
    for d in np.unique(dims):
        rows, g = np.flatnonzero(dims == d), directions(int(d), plan)
        for i in range(0, len(rows), most):
            yield int(d), rows[i : i + most], matrix(batch["unit"].take(pa.array(rows[i : i + most]))) @ g


def fit_cells(index: DataFrame, plan: Plan, rows: int) -> dict[int, Tree]:
    """The upper tree of each length, from the projections of a bounded sample: the rows with the smallest hashes."""
    cells = max(1, min(plan.most_cells, math.ceil(rows / plan.block)))
    if cells == 1:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, points in _by_length(batch, plan):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, dtype=np.int32)), pa.array(list(points), pa.list_(pa.float64()))], ["dims", "point"])

    some = index.orderBy("h").limit(plan.sample).select("dims", "unit").mapInArrow(run, "dims int, point array<double>").toPandas()
    return {int(d): Tree(np.stack(part["point"].to_numpy()), max(1, len(some) // cells)) for d, part in some.groupby("dims")}


def located(rows: DataFrame, trees: dict[int, Tree], plan: Plan) -> DataFrame:
    """``rows`` (dims, unit) with ``cell``; a length that the sample lacks has one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int32)
            for d, at, points in _by_length(batch, plan):
                out[at] = trees[d].cells(points) if d in trees else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, f"{_schema(rows)}, cell int")


def reached(queries: DataFrame, trees: dict[int, Tree], plan: Plan) -> DataFrame:
    """``queries`` (dims, unit, bound) with ``cells``: those whose box lies within the radius of the stopping test."""
    limit = chi_square_quantile(plan.sure, plan.m)
    boxes = {d: t.boxes(plan.m) for d, t in trees.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound, out = batch["bound"].to_numpy(zero_copy_only=False), [[0]] * len(batch)
            for d, at, points in _by_length(batch, plan):
                if d in boxes:
                    near = box_distance(points, *boxes[d]) <= (limit * np.maximum(2 - 2 * bound[at], 0.0) + SLACK)[:, None]
                    for i, row in zip(at, near, strict=True):
                        out[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return queries.mapInArrow(run, f"{_schema(queries)}, cells array<int>")


FOUND = "query_id long, q_hash long, vec_id long, same boolean, score double"


def search(asked: DataFrame, blocks: DataFrame, plan: Plan) -> DataFrame:
    """The best k + 1 rows of each block for each query sent to it. ``asked`` and ``blocks`` have dims, cell and part, ``asked`` has a chunk and a bound."""
    on, to = ["dims", "cell", "part", "chunk"], ["_dims", "_cell", "_part", "_chunk"]
    pairs = asked.select(*(F.col(a).alias(b) for a, b in zip(on, to, strict=True))).distinct()
    sent = blocks.join(pairs, [F.col(a) == F.col(b) for a, b in zip(on[:3], to[:3], strict=True)]).drop(*on[:3])
    names, types = [c.split()[0] for c in FOUND.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in types], names)
        q_vectors, vectors = matrix(left["v"]), matrix(right["v"])
        best = search_block(plan, matrix(right["unit"]), vectors, right["ids"].combine_chunks(), matrix(left["unit"]), q_vectors, left["bound"].to_numpy())
        same = (q_vectors[best.query] == vectors[best.entry]).all(axis=1)
        taken = left.select(["query_id", "h"]).take(pa.array(best.query))
        return pa.table([taken["query_id"], taken["h"], pa.array(best.id), pa.array(same), pa.array(best.score)], names)

    return asked.groupBy(*on).cogroup(sent.groupBy(*to)).applyInArrow(run, FOUND)


def top(found: DataFrame, keep: int) -> DataFrame:
    """``found`` with ``place``, up to ``keep`` of them for each query; cut in each task before the shuffle."""
    w = Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def nearest(vectors: DataFrame, every: int = 50, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """(query_id, rank, vec_id, score): the nearest rows of each row of ``vectors`` whose id is divisible by ``every``."""
    vectors = vectors.select("vec_id", "embedding")
    index = materialize(entries(vectors, plan.k), "entries")
    trees = fit_cells(index, plan, index.count())
    placed = located(index, trees, plan)
    # A cell's rows are counted, so that a crowded one is dealt into blocks by hash. Cells are at most most_cells for each length.
    sizes = materialize(placed.groupBy("dims", "cell").agg(F.expr(f"int((count(*) - 1) div {plan.block} + 1)").alias("parts")), "cells")
    blocks = materialize(placed.join(sizes, ["dims", "cell"]).withColumn("part", F.expr("int(pmod(xxhash64(h, 1), parts))")).drop("parts"), "blocks")

    # Queries are read from all rows, as an entry holds only its smallest ids. Equal rows of an id are one query.
    own = usable(vectors.where(F.col("vec_id") % every == 0)).withColumnRenamed("vec_id", "query_id").distinct()
    asked = materialize(located(scaled(own.withColumn("h", F.xxhash64("raw"))), trees, plan).withColumn("bound", F.lit(float("-inf"))), "queries")
    # Chunks are neighbouring cells with about ``chunk`` queries; a crowded one is dealt by hash.
    cells_each = max(1, plan.chunk * max(1, sum(len(t.leaves) for t in trees.values())) // max(1, asked.count()))
    asked = asked.withColumn("_near", F.expr(f"cell div {cells_each}"))
    crowds = asked.groupBy("dims", "_near").agg(F.expr(f"(count(*) - 1) div {plan.chunk} + 1").alias("_parts"))
    chunked = asked.join(crowds, ["dims", "_near"]).withColumn("chunk", F.struct("_near", F.expr("pmod(xxhash64(query_id, h, 2), _parts)").alias("_of"))).drop("_near", "_parts")
    asked = materialize(chunked.withColumn("chunk", F.concat_ws("/", "chunk._near", "chunk._of")), "chunks")

    if trees:
        home = asked.join(sizes, ["dims", "cell"]).withColumn("part", F.expr("int(pmod(xxhash64(query_id, h, 3), parts))")).drop("parts")
        first = top(search(home, blocks, plan), plan.k + 1).where(F.col("place") == plan.k + 1)
        bounds = first.select("query_id", F.col("q_hash").alias("h"), F.col("score").alias("_bound"))
        asked = asked.join(bounds, ["query_id", "h"], "left").withColumn("bound", F.coalesce("_bound", "bound")).drop("_bound")
        asked = materialize(asked, "bounds")
    visits = reached(asked.drop("cell"), trees, plan).withColumn("cell", F.explode("cells")).drop("cells").join(sizes, ["dims", "cell"])
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = top(search(materialize(visits, "visits"), blocks, plan), plan.k + 1)
    # A query's own row is left out once; where it isn't among the first k + 1, others that are as near have smaller ids.
    at = Window.partitionBy("query_id", "q_hash").orderBy("place")
    itself = F.col("same") & (F.col("vec_id") == F.col("query_id"))
    nth = F.sum(itself.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    others = found.withColumn("_nth", nth).where(~(itself & (F.col("_nth") == 1))).withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= plan.k)
    return others.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
