"""The augmented Dickey-Fuller test from one aggregation: no task holds a series.

All lag orders regress the same step on the level before it, a constant and some of the steps before. Their cross products make
one matrix, which chunks of a cut series add to; a single Cholesky factor of it holds the residuals of every order, as the
last row of the factor is what each further regressor takes off. The order with the least AIC is fitted again over the rows that
a shorter order has more of, which are among the first of the series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import settled
from ..schema import finite
from . import chunks
from .chunks import CHUNK, LENGTH, POS, Long
from .kernels import mackinnon_p


def most_lags(n: int) -> int:
    """The greatest order tried for ``n`` values."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def design(x: np.ndarray, lags: int) -> np.ndarray:
    """A row for each step that has ``lags`` steps before it: a constant, the level before it, the steps before it, the step itself."""
    step = np.diff(x)
    n = len(step) - lags
    return np.column_stack([np.ones(n), x[lags:-1], *(step[lags - k : len(step) - k] for k in range(1, lags + 1)), step[lags:]])


def best_order(gram: np.ndarray, rows: int) -> int:
    """The order with the least AIC, of equals the shortest; ``gram`` is design()'s cross product at the greatest."""
    factor = np.linalg.cholesky(gram)
    # The last row holds the step's part along each regressor in turn; what is left after the first k + 2 is the residual.
    left = np.cumsum((factor[-1] ** 2)[::-1])[::-1]
    orders = np.arange(len(gram) - 2)
    aic = rows * (np.log(2 * np.pi * left[2:] / rows) + 1) + 2 * (orders + 2)
    return int(aic.argmin())


def statistic(gram: np.ndarray, rows: int) -> float:
    """The level's coefficient over its standard error."""
    regressors, target = gram[:-1, :-1], gram[:-1, -1]
    beta = np.linalg.solve(regressors, target)
    rss = float(gram[-1, -1] - beta @ target)
    free = rows - len(beta)
    return float(beta[1] / math.sqrt(rss / free * np.linalg.inv(regressors)[1, 1])) if free > 0 and rss > 0 else math.nan


def dickey_fuller(df: DataFrame, keys: list[str], long: Long, x: str = "close", lags: int | None = None) -> DataFrame:
    """(keys, n, lags, tau, p_value) of each series, constant included; the order by AIC unless ``lags`` is given.

    Values that aren't finite are left out. A series with fewer than 20 values, or that doesn't move, has p_value 1 and no tau.
    """
    values = df.where(finite(F.col(x).cast("double")).isNotNull()).select(*keys, "ts", F.col(x).cast("double").alias("_x"))
    rows = settled(chunks.numbered(values, keys, long))
    series = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_x").alias("_sd"), F.avg("_x").alias("_mean"))
    longest = series.agg(F.max("n")).first()[0] or 0
    reach = lags if lags is not None else most_lags(longest)
    # The test doesn't know a shift of the levels: without their mean, cross products keep their digits.
    shifted = rows.join(series.select(*keys, "_mean"), keys).withColumn("_x", F.col("_x") - F.col("_mean")).drop("_mean")
    fields = [f for f in values.schema.fields if f.name in keys]
    entries = T.StructType([*fields, T.StructField("_i", T.IntegerType()), T.StructField("_j", T.IntegerType()), T.StructField("_v", T.DoubleType())])

    def products(part: pd.DataFrame) -> pd.DataFrame:
        """What a chunk, with the rows before it that its steps need, adds to the matrix of its series."""
        part = part.sort_values(POS, kind="stable")
        order = lags if lags is not None else most_lags(int(part[LENGTH].iloc[0]))
        own = int((part[POS] // long.rows == part[CHUNK].iloc[0]).sum())
        at = part["_x"].to_numpy()[max(0, len(part) - own - order - 1) :]
        z = design(at, order) if len(at) > order + 1 else np.zeros((0, order + 3))
        gram = z.T @ z
        i, j = np.tril_indices(len(gram))
        return pd.DataFrame({**{k.name: part[k.name].iloc[0] for k in fields}, "_i": i.astype("int32"), "_j": j.astype("int32"), "_v": gram[i, j]})[[f.name for f in entries.fields]]

    last = F.floor((F.col(LENGTH) - 1) / long.rows)
    cut = shifted.withColumn(CHUNK, F.explode(F.sequence(F.floor(F.col(POS) / long.rows), F.least(F.floor((F.col(POS) + reach + 1) / long.rows), last))))
    gram = cut.groupBy(*keys, CHUNK).applyInPandas(products, entries).groupBy(*keys, "_i", "_j").agg(F.sum("_v").alias("_v"))
    heads = shifted.where(F.col(POS) <= 2 * reach + 1).join(series.select(*keys, "n", "_sd"), keys).select(*keys, POS, "_x", "n", "_sd")
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("lags", T.IntegerType()), T.StructField("tau", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def decide(cells: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        """From a matrix and the first rows of a series, as many as orders that it was tried for."""
        head = head.sort_values(POS)
        n, order, tau, p = int(head["n"].iloc[0]), None, math.nan, 1.0
        if n >= 20 and head["_sd"].iloc[0] >= 1e-12:
            size = int(cells["_i"].max()) + 1
            full = np.zeros((size, size))
            full[cells["_i"], cells["_j"]] = cells["_v"]
            full += np.tril(full, -1).T
            most = size - 3
            try:
                order = best_order(full, n - 1 - most) if lags is None else lags
                keep = [*range(order + 2), size - 1]
                extra = design(head["_x"].to_numpy()[: most + 1], order) if most > order else np.zeros((0, order + 3))
                tau = statistic(full[np.ix_(keep, keep)] + extra.T @ extra, n - 1 - order)
                p = mackinnon_p(tau)
            except np.linalg.LinAlgError:
                order = None
        row = [*(head[k.name].iloc[0] for k in fields), n, order, tau, p]
        return pd.DataFrame([row], columns=[f.name for f in out.fields]).astype({"lags": "Int32"})

    found = gram.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(decide, out)
    return found.withColumn("tau", F.nanvl("tau", F.lit(None).cast("double")))
