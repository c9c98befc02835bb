"""A grid of configurations as a few Spark jobs.

Bars of a time frame are prepared once for all symbols; each batch of hypotheses is one plan, the union of its strategies'
targets on all their symbols, followed by one ledger over (config_id, symbol). A batch that fails is run again one by one, so that
a faulty configuration becomes an error row and spoils no other. Verdicts follow when all ledgers of a group are there.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import significance
from ..operators import align, bars, chunks
from ..operators.chunks import Long
from ..operators.resample import resample
from ..schema import periods_per_year, step_seconds
from ..sources import runs_store
from ..sources.experiment import Cell, Experiment, canonical
from . import ledger as books_module
from . import causality, strategies, verdict

KEYS = ["config_id", "symbol"]
BATCH = 16


def cut_of(timeframe: str, rows: int | None) -> Long | None:
    """How series of a time frame are cut; None leaves a series to a task."""
    return Long(rows, step_seconds(timeframe)) if rows else None


def prepare(minutes: DataFrame, source: str, target: str, funding: DataFrame | None = None, rows: int | None = None, funded: Collection[str] | None = None) -> DataFrame:
    """Bars of ``target`` with funding_rate, segment and tradable, partitioned by symbol for all that follows, or numbered and cut into chunks of ``rows``.

    Symbols that aren't ``funded`` have no rate rather than none to pay, so strategies that need one fail on them."""
    step = step_seconds(target)
    found = resample(minutes, ["symbol"], source, target)
    if funding is not None:
        found = align.attach_funding(found, funding, ["symbol"], step, on_grid=True)
        if funded is not None:
            found = found.withColumn("funding_rate", F.when(F.col("symbol").isin(list(funded)), F.col("funding_rate")))
    long = cut_of(target, rows)
    return bars.with_tradable(bars.with_segments(found, ["symbol"], step, long), ["symbol"], long=long)


@dataclass(frozen=True)
class Hypothesis:
    """Cells that differ in their symbol alone: one strategy over several series, in one plan."""

    cells: tuple[Cell, ...]

    @property
    def experiment(self) -> Experiment:
        return self.cells[0].experiment

    @property
    def key(self) -> str:
        return self.cells[0].config_id

    def of(self, prepared: DataFrame) -> DataFrame:
        """The bars of its symbols as its strategy sees them."""
        own = prepared.where(F.col("symbol").isin([c.symbol for c in self.cells]))
        return own if "funding_rate" in own.columns or self.strategy().needs_funding else own.withColumn("funding_rate", F.lit(0.0))

    def strategy(self) -> strategies.Strategy:
        return strategies.make(self.experiment.strategy, self.experiment.params)

    def without(self, ids: Collection[str]) -> Hypothesis | None:
        left = tuple(c for c in self.cells if c.config_id not in ids)
        return Hypothesis(left) if left else None


def targets(prepared: DataFrame, hypothesis: Hypothesis, long: Long | None = None) -> DataFrame:
    """The bars of a hypothesis with config_id, net, gross and carry."""
    strategy = hypothesis.strategy()
    run = strategies.mask_targets(strategies.run_segmented(strategy, hypothesis.of(prepared), ["symbol"], long), strategy)
    legs = ("net", "gross", "carry") if strategy.legs else ("target",) * 3
    if not strategy.legs:
        run = run.withColumn("target", F.coalesce("target", F.lit(0.0)))
    kept = ["symbol", "ts", "close", "quote_volume", "funding_rate", *(F.col(c).alias(n) for c, n in zip(legs, ("net", "gross", "carry"), strict=True))]
    kept += [c for c in (chunks.POS, chunks.LENGTH) if c in run.columns]
    ids = F.create_map(*(F.lit(x) for c in hypothesis.cells for x in (c.symbol, c.config_id)))
    return run.select(F.element_at(ids, F.col("symbol")).alias("config_id"), *kept, F.lit(strategy.legs).alias("two_legs"))


def ledgers(prepared: DataFrame, batch: Sequence[Hypothesis], rows: int | None = None) -> DataFrame:
    """The ledgers of hypotheses with equal costs as one plan. A single leg trades its signed position, two legs their gross."""
    first = batch[0].experiment
    costs, long = books_module.Costs.from_config(first.costs), cut_of(first.timeframe, rows)
    return books_module.ledger(reduce(DataFrame.unionByName, [targets(prepared, h, long) for h in batch]), KEYS, costs, legs=True, long=long)


def not_causal(prepared: DataFrame, batch: Sequence[Hypothesis], rows: int | None = None) -> dict[str, str]:
    """What the causality harness has against cells of a batch, by config_id: one job for all hypotheses and symbols."""
    symbols = sorted({c.symbol for h in batch for c in h.cells})
    long = cut_of(batch[0].experiment.timeframe, rows)
    said = causality.failures({h.key: h.strategy() for h in batch}, prepared.where(F.col("symbol").isin(symbols)), ["symbol"], long)
    return {c.config_id: said[h.key, c.symbol] for h in batch for c in h.cells if (h.key, c.symbol) in said}


def hypotheses(cells: Sequence[Cell]) -> list[Hypothesis]:
    """Cells by what they try, each symbol once."""
    by: dict[str, dict[str, Cell]] = {}
    for c in cells:
        e = c.experiment
        by.setdefault(canonical([e.strategy, e.params, e.timeframe, e.start, e.end, e.costs, e.validation]), {}).setdefault(c.symbol, c)
    return [Hypothesis(tuple(own.values())) for own in by.values()]


def _groups(cells: list[Cell]) -> list[list[list[Hypothesis]]]:
    """Hypotheses over the same stretch of time, each group cut into batches of equal costs and gates: a batch is a matter of execution only."""
    by: dict[str, dict[str, list[Hypothesis]]] = {}
    for h in hypotheses(cells):
        e = h.experiment
        by.setdefault(canonical([e.timeframe, e.start, e.end]), {}).setdefault(canonical([e.costs, e.validation]), []).append(h)
    return [[own[i : i + BATCH] for own in group.values() for i in range(0, len(own), BATCH)] for group in by.values()]


def group_matrix(books: Sequence[DataFrame]) -> DataFrame:
    """The long returns matrices of a group's ledgers, one for each symbol."""
    return reduce(DataFrame.unionByName, [b.select("symbol", "config_id", "ts", F.col("returns").alias("ret")) for b in books])


def group_overfitting(books: Sequence[DataFrame], cells: Sequence[Cell]) -> DataFrame:
    """(symbol, pbo, unjudged): the probability over all of a symbol's configurations, or why its matrix is no use."""
    count = Counter(c.symbol for c in cells)
    matrix = group_matrix(books)
    many = matrix.where(F.col("symbol").isin([s for s, n in count.items() if n > 1]))
    wrong: dict[str, list[str]] = {}
    for f in align.check_returns_matrix(many, ["symbol"]).orderBy("symbol", "fault", "config_id").collect():  # some for each configuration
        wrong.setdefault(f["symbol"], []).append(f"{f['config_id']} {f['fault']}")
    fit = many.where(~F.col("symbol").isin(list(wrong))) if wrong else many
    found = {r["symbol"]: r["pbo"] for r in significance.overfitting(fit, keys=["symbol"]).collect()}  # a row for each symbol
    unfit = lambda s: "overfitting not judged: the group's matrix is unfit: " + "; ".join(wrong[s][:4])
    rows = [(s, found.get(s), verdict.NO_PBO if n < 2 else unfit(s) if s in wrong else None) for s, n in count.items()]
    return matrix.sparkSession.createDataFrame(rows, "symbol string, pbo double, unjudged string")


def _rows(found: DataFrame, cells: list[Cell], data_version: str, seconds: float) -> DataFrame:
    spark = found.sparkSession
    known = spark.createDataFrame(
        [(c.config_id, c.index, c.symbol, c.experiment.timeframe, c.experiment.strategy, canonical(c.experiment.params), c.experiment.start, c.experiment.end or "",
          canonical({**verdict.THRESHOLDS, **c.experiment.validation}), canonical(c.experiment.costs)) for c in cells],
        "config_id string, index long, _symbol string, timeframe string, strategy string, params_json string, start string, end string, thresholds_json string, costs_json string",
    )
    joined = found.join(F.broadcast(known), "config_id").drop("_symbol")  # one batch
    return joined.select(
        *known.drop("_symbol").columns, "symbol", "sharpe", "dsr", "p_value", "pbo", F.col("max_drawdown").alias("max_dd"), "total_return", "trades", "cost_total", "alive", "screening",
        "n_trials", "n_permutations", F.array_join("reasons", " | ").alias("reasons"), F.array_join("warnings", " | ").alias("warnings"),
        F.lit(data_version).alias("data_version"), F.lit(seconds).alias("duration_s"),
    )


def _failed(spark, cell: Cell, data_version: str, error: Exception) -> DataFrame:
    e = cell.experiment
    row = (cell.config_id, cell.index, cell.symbol, e.timeframe, e.strategy, canonical(e.params), e.start, e.end or "", data_version, f"{type(error).__name__}: {error}"[:500])
    return spark.createDataFrame([row], "config_id string, index long, symbol string, timeframe string, strategy string, params_json string, start string, end string, data_version string, error string")


def sweep(
    cells: list[Cell], load: Callable[[list[str], str, str, str | None], DataFrame], store: str, spark, data_version: str, prior_trials: int = 0, screening: bool = False, force: bool = False, causal: bool = True, notes: Sequence[str] = (), rows: int | None = None,
) -> dict[str, int]:
    """Run what the store lacks. ``load`` gives prepared bars for (symbols, timeframe, start, end).

    The symbols of a group are one plan. Its ledgers are written first, batch by batch; overfitting is then judged for each symbol over
    all configurations that succeeded, and the group's rows are stored together. With ``causal`` every configuration first passes the
    causality harness, a batch at a time; one that looks ahead becomes an error row and has no ledger. With ``rows`` series are
    cut into chunks of as many bars. A matrix holds the configurations that this call runs, not those of earlier calls.
    """
    todo = cells
    if not force:
        done = {r[0] for r in runs_store.completed_ids(runs_store.read_runs(spark, store), data_version, screening).collect()}  # ids of one grid
        todo = [c for c in cells if c.config_id not in done]
    counts = {"cells": len(cells), "run": len(todo), "failed": 0}
    n_trials = max(1, prior_trials + len(todo))
    scratch = f"{store}.scratch-{uuid.uuid4().hex}"

    def fail(cell: Cell, error: Exception) -> DataFrame:
        counts["failed"] += 1
        return runs_store.normalize_runs(_failed(spark, cell, data_version, error))

    def written(batch: list[Hypothesis], failed: list[DataFrame]) -> tuple[list[Cell], DataFrame | None]:
        """The cells of a batch that have bars and are causal, and their ledgers."""
        e, path = batch[0].experiment, f"{scratch}/{uuid.uuid4().hex}"
        symbols = sorted({c.symbol for h in batch for c in h.cells})
        prepared = load(symbols, e.timeframe, e.start, e.end)
        there = {r["symbol"] for r in prepared.select("symbol").distinct().collect()}  # symbols of one grid
        wrong: dict[str, Exception] = {c.config_id: FileNotFoundError(f"no bars of {c.symbol} in the range") for h in batch for c in h.cells if c.symbol not in there}
        good = [left for h in batch if (left := h.without(wrong))]
        if causal and good:
            said = {k: causality.CausalityError(v) for k, v in not_causal(prepared, good, rows).items()}
            wrong |= said
            good = [left for h in good if (left := h.without(said))]
        if good:
            chunks.bare(ledgers(prepared, good, rows)).write.parquet(path)
        failed += [fail(c, wrong[c.config_id]) for h in batch for c in h.cells if c.config_id in wrong]
        return [c for h in good for c in h.cells], spark.read.parquet(path) if good else None

    def books_of(batches: list[list[Hypothesis]], failed: list[DataFrame]) -> list[tuple[list[Cell], DataFrame, float]]:
        out = []
        for batch in batches:
            start, own = time.time(), [c for h in batch for c in h.cells]
            try:
                out.append((*written(batch, failed), (time.time() - start) / len(own)))
            except Exception:
                for cell in own:
                    start = time.time()
                    try:
                        out.append((*written([Hypothesis((cell,))], failed), time.time() - start))
                    except Exception as error:
                        failed.append(fail(cell, error))
        return [(good, book, seconds) for good, book, seconds in out if good]

    try:
        for batches in _groups(todo):
            found_rows: list[DataFrame] = []
            books = books_of(batches, found_rows)
            pbo = group_overfitting([b for _, b, _ in books], [c for own, _, _ in books for c in own]) if books else None
            for own, book, seconds in books:
                e = own[0].experiment
                found = verdict.verdicts(book, books_module.trade_returns(book, KEYS, cut_of(e.timeframe, rows)), KEYS, n_trials, float(periods_per_year(e.timeframe)), pbo, e.validation, screening, notes=notes)
                found_rows.append(runs_store.normalize_runs(_rows(found, own, data_version, seconds)))
            if found_rows:
                runs_store.write_runs(reduce(DataFrame.unionByName, found_rows), store)
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return counts
