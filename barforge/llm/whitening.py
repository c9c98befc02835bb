"""Embedding whitening by hierarchical merging of singular value decompositions.

Every task keeps of its rows their number, their mean and all singular values and right vectors of the centred rows: d
numbers and a d by d matrix, whatever the number of rows. Two such summaries merge by stacking their scaled vectors with
one row more, the difference of the means weighted by sqrt(n m / (n + m)), and decomposing the stack again; nothing is
truncated, so the merged summary is that of all rows up to rounding. Merges go up a tree of a fixed fan-in in tasks.

Entries become integers first, x = floor(64 c) + 1000000, so counts and sums are exact. Before means are taken a task
subtracts the first integer row of each batch, exactly, so a large common offset costs no digits.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries or entries too large for a long
integer, take no part. The fit list holds each distinct integer vector once, so repeated rows weigh nothing, yet each gets
its own output. Vectors of another length are another space and are whitened among themselves. Components are numbered by
falling eigenvalue, their largest entry (the first of equals) is positive; where an eigenvalue is zero up to rounding the
whitened value is null and the component has no part in identity_error. ``deviation`` is null if it exceeds a long integer.
A null id is kept. Other columns are not read, so they can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: What turns an entry into an integer (fixed values of the task).
SCALE, SHIFT = 64, 1_000_000
#: Summaries that one task merges.
FAN_IN = 8
SUMMARY = "d int, part long, n long, mean binary, sigma binary, vt binary"
LONGEST = 2**63 - 1


def decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All d singular values and right vectors of ``rows``."""
    d = rows.shape[1]
    if len(rows) > d:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=True)
    return np.concatenate([s, np.zeros(d - len(s))]), vt


class Summary:
    """Number, mean, singular values and right vectors of a set of rows."""

    def __init__(self, n: int, mean: np.ndarray, sigma: np.ndarray, vt: np.ndarray):
        self.n, self.mean, self.sigma, self.vt = n, mean, sigma, vt

    @classmethod
    def of(cls, rows: np.ndarray, origin: np.ndarray | float = 0.0) -> Summary:
        """Of rows that are given relative to ``origin``."""
        mean = rows.mean(axis=0)
        return cls(len(rows), mean + origin, *decompose(rows - mean))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = other.mean - self.mean
        stack = np.vstack([self.sigma[:, None] * self.vt, other.sigma[:, None] * other.vt, np.sqrt(self.n * other.n / n) * apart])
        return Summary(n, self.mean + apart * (other.n / n), *decompose(stack))

    def packed(self, d: int, part: int) -> tuple:
        return d, part, self.n, *(np.ascontiguousarray(x, dtype="<f8").tobytes() for x in (self.mean, self.sigma, self.vt))

    @classmethod
    def unpacked(cls, n: int, mean: bytes, sigma: bytes, vt: bytes) -> Summary:
        m, s, v = (np.frombuffer(x, dtype="<f8") for x in (mean, sigma, vt))
        return cls(int(n), m, s, v.reshape(len(s), len(s)))


def matrices(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The list column of a batch as a matrix for each length: (length, rows of the batch, matrix)."""
    lists = batch[column]
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, values[starts[rows][:, None] + np.arange(d)]


def summaries(vectors: DataFrame) -> DataFrame:
    """A summary for each length that a task of ``vectors`` (x, an array of numbers) meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, Summary] = {}
        for batch in batches:
            for d, _, x in matrices(batch):
                here = Summary.of((x - x[0]).astype("float64"), x[0].astype("float64"))
                found[d] = found[d].merged(here) if d in found else here
        rows = [s.packed(d, TaskContext.get().partitionId()) for d, s in sorted(found.items())]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")]).astype({"d": "int32", "part": "int64", "n": "int64"}), preserve_index=False)

    return vectors.select("x").mapInArrow(run, SUMMARY)


def merge_all(parts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One summary for each length, by a tree of merges; ``parts`` is materialized."""
    fields = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, total = group.sort_values("part"), None
        for r in group.itertuples():
            here = Summary.unpacked(r.n, r.mean, r.sigma, r.vt)
            total = total.merged(here) if total else here
        return pd.DataFrame([total.packed(int(group["d"].iloc[0]), int(group["part"].iloc[0]) // fan_in)], columns=fields)

    most = parts.agg(F.max("part")).first()[0] or 0
    while most:
        parts = parts.groupBy("d", F.expr(f"part div {fan_in}").alias("_to")).applyInPandas(run, SUMMARY)
        most //= fan_in
    return parts


def integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows of ``vectors`` (vec_id, embedding) that take part, x an array of long."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) * scale < 2.0**62, F.lit(False))  # noqa: E731  false for NaN too
    whole = F.coalesce(F.forall("embedding", fits) & (F.size("embedding") > 0), F.lit(False))
    return vectors.where(whole).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale) + shift).alias("x"))


class Whitener:
    """Exact counts and sums of a fit list and its components, for vectors of one length."""

    def __init__(self, summary: Summary, sums: list[int], most: int):
        self.n, self.sums = summary.n, sums
        e = summary.sigma**2 / self.n
        self.trace, k = float(e.sum()), min(most, len(e))
        flip = np.sign(summary.vt[np.arange(len(e)), np.abs(summary.vt).argmax(axis=1)])
        self.e, self.vt = e[:k], (summary.vt * flip[:, None])[:k]
        self.flat = ~(self.e > self.trace * 1e-13)

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values of the rows of ``x``, and their exact deviations."""
        low, high = int(x.min()), int(x.max())
        reach = max(max(abs(self.n * low - s), abs(self.n * high - s)) for s in self.sums)
        apart = self.n * (x if reach <= LONGEST and self.n * max(abs(low), abs(high)) <= LONGEST else x.astype(object)) - np.array(self.sums, dtype=None if max(map(abs, self.sums)) <= LONGEST else object)
        square = apart if len(self.sums) * reach * reach <= LONGEST else apart.astype(object)
        exact = [int(v) if v <= LONGEST else None for v in (square * square).sum(axis=1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (apart.astype("float64") / self.n) @ self.vt.T / np.sqrt(self.e)
        out[:, self.flat] = np.nan
        return out, exact


def identity_error(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """For each length the largest entry, in absolute value, of the covariance of the whitened fit list less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * len(batch)
            for d, rows, x in matrices(batch):
                white = models[d].whitened(x)[0][:, ~models[d].flat]
                for i, w in zip(rows, white, strict=True):
                    out[i] = w
            yield pa.RecordBatch.from_arrays([batch["d"], pa.array(out, pa.list_(pa.float64()))], ["d", "x"])

    # Lengths may agree after projection: a space is one at a time, as spaces are few.
    white = fit.select(F.size("x").alias("d"), "x").mapInArrow(run, "d int, x array<double>")
    found = {}
    for d, model in models.items():
        if model.flat.all():
            continue
        merged = merge_all(materialize(summaries(white.where(F.col("d") == d)), "whitened")).first()
        s = Summary.unpacked(merged["n"], merged["mean"], merged["sigma"], merged["vt"])
        found[d] = float(np.abs((s.vt.T * s.sigma**2) @ s.vt / s.n - np.eye(len(s.sigma))).max())
    return found


def fit_whiteners(fit: DataFrame, components: int = 16) -> dict[int, Whitener]:
    """A whitener for each length of the distinct integer vectors of ``fit`` (x), which is materialized."""
    # Sums as decimals, entry by entry: one row for each dimension leaves a task.
    exploded = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums: dict[int, dict[int, int]] = {}
    for r in exploded.collect():  # d rows for each length
        sums.setdefault(r["d"], {})[r["i"]] = int(r["s"])
    merged = merge_all(materialize(summaries(fit), "summaries")).collect()  # one row for each length
    return {r["d"]: Whitener(Summary.unpacked(r["n"], r["mean"], r["sigma"], r["vt"]), [sums[r["d"]][i] for i in range(r["d"])], components) for r in merged}


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each of its components."""
    rows = integers(vectors)
    fit = materialize(rows.select("x").distinct(), "fit-list")
    models = fit_whiteners(fit, components)
    errors = identity_error(fit, models)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"]
            for d, at, x in matrices(batch):
                m = models[d]
                white, exact = m.whitened(x)
                k, n = white.shape[1], len(at)
                share = m.e / m.trace if m.trace > 0 else np.full(k, np.nan)
                columns = [
                    ids.take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)),
                    pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(white.ravel(), from_pandas=True),
                    pa.array(np.tile(share, n), from_pandas=True), pa.array([errors.get(d)] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, schema)
