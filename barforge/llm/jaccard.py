"""N-gram Jaccard join with a count-vector R-tree.

A text is the set of its word shingles (64-bit hashes). Texts with equal sets form a class; the document with its smallest id stands for it.

Points. Shingles are hashed into groups; the counts in the groups are a set's point, and the summed coordinate minima of
two points bound the overlap of their sets. Random texts of some length don't differ enough in their counts for a tree
over the whole corpus to tell them apart, so points are indexed by cell: a cell is a shingle, and a set lies in the cells
of its rarest shingles, as many as it takes for any two linked sets to have one in common (prefix_lengths()). What is
rare follows from counts over all texts, so a passage that many documents share brings none of them together unless
their sets consist of little else. No linked pair is missed whatever the counts are, and nothing is capped.

Verifying. First every member of a cell is compared with the cell's first member, if their sizes allow a link: at most as
many pairs as rows; those whose points allow one too are verified on the full sets, and linked nodes get a common label.
What may be left are links between other members of different labels. Their sizes are near: the members of a cell in order
of size are cut wherever the next is too large for a link with the one before, and each run is a cell of its own from then
on. Its points are packed into an R-tree whose boxes keep coordinate
maxima. A box is passed over when the summed minima of query and box fall short of the overlap that a link needs, or
when all of its points have the query's label. In a large corpus most cells hold texts that share a few rare shingles by
chance, more of them than the corpus grows; so the tree goes over the cells twice. First it gets the short vectors alone
and leaves the rows that have a partner; only these go on, with finer counts, a byte for each
shingle: many near copies that are just not linked differ too little for the short vectors, and there are as many pairs
of them as the square of their number. A task hands on a forest, only pairs that join labels which it hasn't joined yet:
fewer than it has nodes. They are verified on the full sets; where all prove to be links, what the forest left out is
joined by them. A bucket with one that isn't is searched again, then for every pair whose labels still differ. Cells
with one first member have much the same members, so they share a bucket; one bucket holds many small cells, and cells
with more members than ``block`` are joined block by block, so no task holds an unbounded group.

Components come from contraction rounds over the links (each node to its smallest neighbour, pointers doubled); links
and components stay distributed, and every round is written to the shared folder.

Defined results: a null or wordless text has an empty set and is linked with nothing; a text with fewer words than a
shingle has one shingle, the whole of it; rows with the same id count as one document, which links the classes of all
its texts; rows with a null id link nothing and get a null component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, fresh, materialize, maybe_broadcast, written

U = np.uint64
#: Groups of the count vectors.
GROUPS = 128
#: Points in a leaf and boxes in a node of the R-tree.
FANOUT = 16
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(977).integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """The finalizer of splitmix64 over ``x`` and a salt."""
    z = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    return tuple(np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(n - 1, b % 2**64, dtype=U))]) for b in (_BASE, pow(_BASE, -1, 2**64)))


def word_hashes(data: bytes, piece: int = 1 << 16) -> np.ndarray:
    """Hashes of the words of ``data``, A to Z taken as a to z, made in pieces that end at white space."""
    raw, out, at = np.frombuffer(data.lower(), dtype=np.uint8), [], 0
    while at < len(raw):
        stop = min(at + piece, len(raw))
        while stop < len(raw) and not _SPACES[raw[stop]]:  # a word is never cut
            ahead = np.flatnonzero(_SPACES[raw[stop : stop + piece]])
            stop += int(ahead[0]) if len(ahead) else min(piece, len(raw) - stop)
        out.append(_hash_piece(raw[at:stop]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, U)


def _hash_piece(raw: np.ndarray) -> np.ndarray:
    """Polynomials of each word's bytes, from one running sum."""
    size = 1 << max(12, int(len(raw)).bit_length())
    power, inverse = _powers(size)
    space = _SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[raw] * power[: len(raw)], dtype=U)])
    return mix((total[stop] - total[start]) * inverse[start], 1) ^ (stop - start).astype(U)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, U)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, U)
    for k in range(width):
        out = mix(out ^ words[k : k + n], 2 + k)
    return np.unique(out)


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed longs."""
    a, b = (int(mix(found, s).sum(dtype=U)) if len(found) else 0 for s in (21, 22))
    return tuple(x - 2**64 if x >= 2**63 else x for x in (a, b))


def count_vector(found: np.ndarray) -> bytes:
    """Shingles in each group: a byte for each where that is enough, else four."""
    counts = np.bincount((mix(found, 23) >> U(57)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def codes(found: np.ndarray) -> np.ndarray:
    """The sorted 15-bit codes of a set's shingles; the upper 7 bits are the group."""
    return np.sort((mix(found, 23) >> U(49)).astype(np.uint16))


def fine_counts(found: np.ndarray) -> bytes:
    """The lower byte of each of the codes(), which follow from it and the count vector."""
    return codes(found).astype(np.uint8).tobytes()


def codes_of(counts: np.ndarray, fine: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a set, and how many equal ones stand before each."""
    each = np.repeat(np.arange(GROUPS), counts) << 8 | np.frombuffer(fine, dtype=np.uint8)
    return each.astype(np.uint16), (np.arange(len(each)) - np.searchsorted(each, each)).astype(np.int32)


def counts_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint8 if len(packed) == GROUPS else "<u4").astype(np.int64)


def need(percent: int, total: np.ndarray | int):
    """The least overlap of two linked sets with ``total`` members together: overlap >= percent / (100 + percent) * total."""
    return -(-percent * total // (100 + percent))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest shingles bring a set of ``n`` together with others: with sets up to its own size, and with larger ones.

    Of two sets that share ``o`` shingles, the rarest ``n - o + 1`` of each have one in common. Linked sets share at least
    ``percent`` of the larger one, and need() of twice the smaller one.
    """
    return n - -(-percent * n // 100) + 1, n - need(percent, 2 * n) + 1


@dataclass(frozen=True)
class Order:
    """A total order of shingles: those not listed first, by hash; those listed as frequent last, by their count and hash."""

    frequent: np.ndarray
    counts: np.ndarray

    def rarest(self, found: np.ndarray, most: int) -> np.ndarray:
        if not len(self.frequent):
            return found[:most]
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        listed = self.frequent[at] == found
        rare = found[~listed][:most]
        if len(rare) == most:
            return rare
        again = np.flatnonzero(listed)
        again = again[np.argsort(self.counts[at[again]], kind="stable")]
        return np.concatenate([rare, found[again[: most - len(rare)]]])


NOTHING = Order(np.zeros(0, U), np.zeros(0, np.int64))
SKETCH = "doc_id long, n long, d1 long, d2 long, often array<bigint>, times array<bigint>"
#: Shingles that a task holds at once while it counts, and the count from which it reports one.
HELD, REPORTED = 1 << 21, 3


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """For every row: size and digest of its shingle set; some rows carry what the task has counted several times since the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            at = 0
            while at < batch.num_rows:
                rows, sets, held, first = [], {}, 0, at
                while at < batch.num_rows and held < HELD:
                    found = shingle_set(texts[at].as_py(), width)
                    rows.append((len(found), *digest(found)))
                    if rows[-1] not in sets:  # copies count once
                        sets[rows[-1]] = found
                        held += len(found)
                    at += 1
                each, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = times >= REPORTED
                blank = [None] * (len(rows) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[first:at], *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)),
                        pa.array([*blank, each[often].view(np.int64)], pa.list_(pa.int64())), pa.array([*blank, times[often]], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "d1", "d2", "often", "times"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def frequent_order(counted: DataFrame, most: int = 1 << 19) -> Order:
    """The order in which the ``most`` most frequent (h, c) come last. Any order is exact; one that knows what is frequent meets less."""
    octaves = dict(counted.groupBy(F.floor(F.log2("c")).alias("octave")).agg(F.count("*").alias("n")).collect())  # at most 63 rows
    least, room = 64, most
    for octave in sorted(octaves, reverse=True):
        room -= octaves[octave]
        if room < 0:
            break
        least = octave
    rows = counted.where(F.floor(F.log2("c")) >= least).collect()  # at most ``most``
    frequent, counts = np.array([r["h"] for r in rows], np.int64).view(U), np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(frequent)
    return Order(frequent[order], counts[order])


def meeting_points(docs: DataFrame, width: int, percent: int, order: Order) -> DataFrame:
    """(node, n, counts, fine, inner, cells) of every row with words: size, counts and rarest shingles, of which ``inner`` meet larger sets as well."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            for at in range(0, batch.num_rows, 500):
                rows, kept = [], []
                for i, text in enumerate(texts[at : at + 500]):
                    found = shingle_set(text.as_py(), width)
                    if len(found):
                        outer, inner = prefix_lengths(len(found), percent)
                        rows.append((ids[at + i].as_py(), len(found), count_vector(found), fine_counts(found), inner))
                        kept.append(known.rarest(found, outer))
                if not rows:
                    continue
                nodes, sizes, counts, fine, inner = zip(*rows, strict=True)
                ends = np.concatenate([[0], np.cumsum([len(c) for c in kept])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()), pa.array(inner, pa.int32()), lists],
                    names=["node", "n", "counts", "fine", "inner", "cells"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "node long, n long, counts binary, fine binary, inner int, cells array<bigint>")


def plausible(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow a link."""
    end = lambda side, c: points.select(F.col("node").alias(f"_{side}"), F.col("counts").alias(c))
    both = pairs.join(end("a", "p"), F.col("a") == F.col("_a")).join(end("b", "q"), F.col("b") == F.col("_b")).select("a", "b", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (p, q) in enumerate(zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)):
                p, q = counts_of(p), counts_of(q)
                keep[i] = np.minimum(p, q).sum() >= need(percent, int(p.sum() + q.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, repeated: DataFrame | None, width: int, percent: int) -> DataFrame:
    """The linked pairs among ``pairs`` (a, b), by their full sets."""
    before = set(written())
    pairs = materialize(pairs, "pairs")
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = materialize(class_sets(docs, maybe_broadcast(nodes, 500_000), repeated, width), "sets")
    end = lambda side, c: sets.select(F.col("node").alias(f"_{side}"), F.col("found").alias(c))
    both = pairs.join(end("b", "y"), F.col("b") == F.col("_b")).join(end("a", "x"), F.col("a") == F.col("_a")).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=U) for c in ("x", "y"))
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    links = materialize(both.mapInArrow(run, "a long, b long"), "links")
    discard(docs.sparkSession, [p for p in written()[:-1] if p not in before])
    return links


class CountTree:
    """An R-tree of count vectors, packed in order of size and of the largest counts."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.counts, self.labels = counts, labels
        size = counts.sum(axis=1)
        order = np.lexsort((*(counts[:, k] for k in range(4)), size))
        self.levels = [(order, counts[order], size[order], labels[order], labels[order])]
        while len(self.levels[-1][0]) > FANOUT:
            _, top, least, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((cut, np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, label: int, percent: int) -> np.ndarray:
        """Points with another label whose bound on the overlap with ``point`` allows a link."""
        size, at = int(point.sum()), np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            _, top, least, low, high = (x[at] for x in self.levels[depth])
            bound = np.minimum(top, point).sum(axis=1)
            at = at[(bound >= need(percent, size + least)) & ~((low == label) & (high == label))]
            if depth:
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return self.levels[0][0][at]


def tree_join(cell: pd.DataFrame, points: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs across two parts of a cell with different labels that the bound lets through, one of them ``inner``."""
    labels, inner = cell["label"].to_numpy(), cell["inner"].to_numpy()
    tree = CountTree(points[right], labels[right])
    for k in left:
        at = right[tree.search(points[k], labels[k], percent)]
        at = at if inner[k] else at[inner[at]]
        yield np.full(len(at), k), at


def leaf_join(rows: pd.DataFrame, points: np.ndarray, starts: np.ndarray, size: int, percent: int, held: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for cells of ``size`` members each that begin at ``starts``: a tree of one leaf, many of them at a time."""
    labels, inner, total = rows["label"].to_numpy(), rows["inner"].to_numpy(), points.sum(axis=1)
    one, other = np.triu_indices(size, 1)
    step = max(1, held // len(one))
    for at in range(0, len(starts), step):
        a, b = ((starts[at : at + step, None] + x).ravel() for x in (one, other))
        open_ = (labels[a] != labels[b]) & (inner[a] | inner[b])
        a, b = a[open_], b[open_]
        open_ = np.minimum(points[a], points[b]).sum(axis=1) >= need(percent, total[a] + total[b])
        yield a[open_], b[open_]


def cell_pairs(rows: pd.DataFrame, points: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs inside the cells of ``rows`` (sorted by cell) that the count vectors let through."""
    cell, i, j, own = (rows[c].to_numpy() for c in ("cell", "i", "j", "own"))
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([start, [len(rows)]]))
    leaf = (size <= FANOUT) & (i[start] < 0)
    for n in np.unique(size[leaf]):
        yield from leaf_join(rows, points, start[(size == n) & leaf], int(n), percent)
    for first, n in zip(start[~leaf], size[~leaf], strict=True):
        all_ = np.arange(first, first + n)
        left, right = (all_, all_) if i[first] < 0 else (all_[own[all_] == i[first]], all_[own[all_] == j[first]])
        if len(left) and len(right):
            yield from tree_join(rows, points, left, right, percent)


def distinct_pairs(pairs: Iterator[tuple[np.ndarray, np.ndarray]], held: int = 1 << 20) -> Iterator[np.ndarray]:
    """The pairs as sorted rows of two; each once among about ``held`` that came together."""
    some, n = [], 0
    for pair in pairs:
        some.append(np.sort(np.stack(pair, axis=1), axis=1))
        n += len(some[-1])
        if n >= held:
            yield np.unique(np.concatenate(some), axis=0)
            some, n = [], 0
    if n:
        yield np.unique(np.concatenate(some), axis=0)


def placed(rows: pd.DataFrame, sketches: pd.DataFrame) -> pd.DataFrame:
    """``rows`` in order of their cells, without first members, each with its point's position among ``sketches``."""
    at = pd.DataFrame({"node": sketches["node"], "point": np.arange(len(sketches))})  # an id with several texts has several points
    return rows[rows["node"] != rows["first"]].merge(at, on="node").sort_values("cell", ignore_index=True)


def bucket_open(rows: pd.DataFrame, sketches: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Those of ``rows`` that have a partner in their cell by the count vectors alone."""
    met, keep = placed(rows.assign(row=np.arange(len(rows))), sketches), np.zeros(len(rows), dtype=bool)
    if len(met):
        row, counts = met["row"].to_numpy(), np.stack([counts_of(c) for c in sketches["counts"]])
        for a, b in cell_pairs(met, counts[met["point"].to_numpy()], percent):
            keep[row[a]] = keep[row[b]] = True
    return rows[keep]


def bucket_join(rows: pd.DataFrame, sketches: pd.DataFrame, percent: int, forest: bool) -> pd.DataFrame:
    """Pairs (a < b) of all cells among ``rows`` that the finer counts of ``sketches`` let through; none with a cell's first member, which is done.

    With ``forest`` only those that join two labels which the pairs before have not joined: fewer than there are nodes.
    """
    out, bucket = set(), int(rows["bucket"].iloc[0])
    rows = placed(rows, sketches)
    if len(rows):
        counts, point, node = np.stack([counts_of(c) for c in sketches["counts"]]), rows["point"].to_numpy(), sketches["node"].to_numpy()
        total, fine = counts.sum(axis=1), sketches["fine"].to_numpy()
        label = np.zeros(len(sketches), np.int64)
        label[point] = rows["label"].to_numpy()
        label, root = label.tolist(), {x: x for x in label.tolist()}
        known = lru_cache(maxsize=1024)(lambda k: codes_of(counts[k], fine[k]))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for pairs in distinct_pairs((point[a], point[b]) for a, b in cell_pairs(rows, counts[point], percent)):
            last, table = -1, None
            for p, q in pairs.tolist():
                if node[p] == node[q] or (forest and top(label[p]) == top(label[q])):
                    continue
                if p != last:
                    last, table = p, np.bincount(known(p)[0], minlength=GROUPS << 8)
                each, before = known(q)
                if np.count_nonzero(table[each] > before) >= need(percent, int(total[p] + total[q])):
                    out.add((min(node[p], node[q]), max(node[p], node[q])))
                    if forest:
                        root[top(label[p])] = top(label[q])
    a, b = zip(*sorted(out), strict=True) if out else ((), ())
    return pd.DataFrame({"bucket": np.full(len(a), bucket), "a": a, "b": b}).astype("int64")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root the smallest node that it reaches."""
    edges = materialize(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "edges")
    labels = edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        up = materialize(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        for _ in range(3):  # pointers doubled: a chain of eight steps becomes one
            over = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            up = up.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
        up = materialize(up, "hooks")
        over = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        labels = materialize(labels.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")
        for end in ("lo", "hi"):
            edges = edges.join(over, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_r", end)).drop("_n", "_r")
        edges = materialize(edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo <> hi").distinct(), "edges")
    return labels


def once(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Each (doc_id, text) once. Only ids known to be ``repeated`` are brought together for that."""
    if repeated is None:
        return rows
    again = repeated.select(F.col("id").alias("_id"))
    single = rows.join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    return single.unionByName(rows.join(again, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"]))


def class_sets(docs: DataFrame, nodes: DataFrame, repeated: DataFrame | None, width: int) -> DataFrame:
    """(node, found): full shingle sets of the documents named in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), width).tobytes() for t in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays([ids[at : at + 500].cast(pa.int64()), pa.array(sets, pa.binary())], names=["node", "found"])

    some = docs.join(nodes.select(F.col("node").alias("_n")), F.col("doc_id") == F.col("_n"), "left_semi")
    return once(some.select(F.col("doc_id").cast("long"), "text"), repeated).mapInArrow(run, "node long, found binary")


def shared_cells(points: DataFrame, percent: int) -> DataFrame:
    """(cell, node, inner, first, near, run): members of every cell with two nodes or more, one of them inner, that may have a link in it.

    ``first`` is the smallest inner node, not listed itself; ``near`` says whether the sizes allow a link with it. Of the others
    in order of size, those between two steps too large for a link have the same ``run``; null for one that is alone.
    """
    each = points.select("node", "n", "inner", F.posexplode("cells").alias("at", "cell")).select("cell", "node", "n", (F.col("at") < F.col("inner")).alias("inner"))
    whole = Window.partitionBy("cell")
    marked = {"first": F.min(F.when(F.col("inner"), F.col("node"))).over(whole), "low": F.min("node").over(whole), "high": F.max("node").over(whole)}
    shared = each.withColumns(marked).where("low <> high and first is not null").select("cell", "node", "n", "inner", "first")
    other, sized = F.col("node") != F.col("first"), whole.orderBy(F.col("node") == F.col("first"), "n")  # first's rows come last
    its = F.when(~other, F.col("n"))  # of an id with several texts the first may have several sizes
    gap = lambda small, large: small.isNull() | large.isNull() | (100 * small < percent * large)
    of_others = F.when(other, F.col("n"))
    sizes = {"least": F.min(its).over(whole), "most": F.max(its).over(whole), "opens": gap(F.lag(of_others).over(sized), F.col("n")), "closes": gap(F.col("n"), F.lead(of_others).over(sized))}
    near = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    run = F.when(~(F.col("opens") & F.col("closes")), F.sum(F.col("opens").cast("int")).over(sized.rowsBetween(Window.unboundedPreceding, 0)))
    found = shared.withColumns(sizes).withColumns({"near": near, "run": run}).where(other & (F.col("near") | F.col("run").isNotNull()))
    return found.select("cell", "node", "inner", "first", "near", "run")


def residual_rows(cells: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Members of the runs in which two have different labels, dealt to buckets. A run is a cell from here on."""
    label = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    runs = cells.where("run is not null").select(F.xxhash64("cell", "run").alias("cell"), "node", "inner", "first")
    named = runs.join(label, F.col("node") == F.col("_n"), "left").select("cell", "node", "inner", "first", F.coalesce("_r", "node").alias("label"))
    marks = named.groupBy("cell").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max("inner").alias("any"),
        F.count("*").alias("size"), F.sum(F.xxhash64("node", "inner").cast("decimal(38,0)")).alias("content"), F.min("first").alias("_first"),
    )
    marks = marks.where("low <> high and any").groupBy("size", "content").agg(F.min("cell").alias("_cell"), F.min("_first").alias("_first"))  # cells with the same members are joined once
    # Cells of up to ``block`` members stay whole and near others of their first member, as many as make up ``block`` rows; of larger ones every two parts meet.
    parts = F.when(F.col("size") > block, F.ceil(F.col("size") / block).cast("int")).otherwise(0)
    before = F.sum("size").over(Window.partitionBy("_first").orderBy("_cell")) - F.col("size")
    marks = marks.select("_cell", parts.alias("parts"), F.floor(before / block).alias("chunk"))
    rows = named.join(marks, F.col("cell") == F.col("_cell"))
    own = F.when(F.col("parts") > 0, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(-1).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    pairs = F.when(F.col("parts") > 0, both).otherwise(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))))
    columns = ("cell", "first", "node", "inner", "label", "chunk")
    rows = rows.select(*columns, own.alias("own"), F.explode(pairs).alias("p"))
    rows = materialize(rows.select(*columns, "own", F.col("p.i").alias("i"), F.col("p.j").alias("j")), "residual")
    buckets = rows.count() // block + 1
    bucket = F.when(F.col("i") < 0, F.pmod(F.xxhash64("first", "chunk"), F.lit(buckets))).otherwise(F.xxhash64("cell", "i", "j"))
    return rows.withColumn("bucket", bucket).drop("chunk")


def with_points(rows: DataFrame, points: DataFrame):
    """The rows of each bucket beside the points of its nodes, ready for a cogrouped map."""
    nodes = materialize(rows.select(F.col("bucket").alias("_b"), F.col("node").alias("_n")).distinct(), "members")
    sketches = maybe_broadcast(nodes, 500_000).join(points, F.col("node") == F.col("_n")).drop("_n")
    return rows.groupBy("bucket").cogroup(sketches.groupBy("_b"))


def open_rows(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The rows that have a partner with another label in their cell as far as the count vectors tell."""
    return with_points(rows, points.select("node", "counts")).applyInPandas(lambda group, held: bucket_open(group, held, percent), rows.schema)


def residual_pairs(rows: DataFrame, points: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(bucket, a, b): pairs inside cells whose members have different labels that the bounds let through, of each bucket all or a forest."""
    return with_points(rows, points).applyInPandas(lambda group, held: bucket_join(group, held, percent, forest), "bucket long, a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text): the smallest id reachable over links."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    sketch = materialize(sketches(docs, width), "sketches")
    counted = sketch.where("often is not null").select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy(F.col("o.often").alias("h"))
    order = frequent_order(materialize(counted.agg(F.sum("o.times").alias("c")), "frequent"))
    full = sketch.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    classes = materialize(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    repeated = materialize(sketch.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("k")).where("k > 1").select("id"), "repeated")
    repeated = None if repeated.isEmpty() else repeated
    named = classes.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "node")
    same = (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))
    copies = full.join(named, same).where("doc_id <> node")
    joined = None
    if repeated is not None:  # every text of such an id is a point; the id links them with the classes of its texts
        joined = copies.join(repeated, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
        joined = materialize(joined, "joined")
        copies = copies.join(repeated, F.col("doc_id") == F.col("id"), "left_anti")
    copies = maybe_broadcast(materialize(copies.select(F.col("doc_id").alias("_copy")), "copies"), 500_000)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(copies, F.col("doc_id") == F.col("_copy"), "left_anti")
    points = materialize(meeting_points(once(own, repeated), width, percent, order), "points")
    cells = materialize(shared_cells(points, percent), "cells")
    points = points.select("node", "counts", "fine")
    stars = materialize(cells.where("near").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = verified(plausible(stars, points, percent), docs, repeated, width, percent)
    if joined is not None:
        links = links.unionByName(joined)
    labels = components(links)
    star = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = materialize(open_rows(residual_rows(cells, labels, block), points, percent), "open")
    forest = materialize(residual_pairs(rows, points, percent, forest=True), "forest")
    found = verified(forest.select("a", "b").distinct().join(star, ["a", "b"], "left_anti"), docs, repeated, width, percent)
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = components(links)
    unsure = materialize(forest.join(found, ["a", "b"], "left_anti").select("bucket").distinct(), "unsure")
    if not unsure.isEmpty():  # a forest with a pair that is no link may have left out one that is
        root = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        again = rows.join(unsure, "bucket", "left_semi").join(root, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_r", "node")).drop("_n", "_r")
        rest = residual_pairs(again, points, percent, forest=False).select("a", "b").distinct()
        found = verified(rest.join(star.unionByName(forest.select("a", "b")), ["a", "b"], "left_anti"), docs, repeated, width, percent)
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    ids = classes.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    ids = ids.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("root", "node").alias("_c"))
    out = sketch.join(ids, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if repeated is None:
        return out
    least = out.join(repeated, F.col("doc_id") == F.col("id"), "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_least"))
    out = out.join(least, F.col("doc_id") == F.col("_id"), "left")  # a wordless row of an id that has words elsewhere
    return out.select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (all rows with a null id stay)."""
    (name,) = fresh(docs, "_d")
    found = jaccard_components(docs, width, percent)
    drop = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "duplicates")
    return docs.join(maybe_broadcast(drop, 500_000), F.col("doc_id") == F.col(name), "left_anti")
