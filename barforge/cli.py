"""Command line: ingest, validate, sweep, report."""

from __future__ import annotations

import argparse
import glob
import json
import os
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .plans import causality, funnel, sweep
from .plans import report as report_plan
from .sources import experiment, journal, klines, lake, runs_store
from .sources import ingest as archives


def session() -> SparkSession:
    return SparkSession.builder.appName("barforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def loader(spark: SparkSession, root: str, freq: str = "1m", rows: int | None = None):
    """Prepared bars by (symbols, timeframe, start, end). Those made last are kept, and let go when others are asked for."""
    made: dict[tuple, DataFrame] = {}

    def load(symbols: list[str], timeframe: str, start: str, end: str | None) -> DataFrame:
        key = (*symbols, timeframe, start, end)
        if key not in made:
            for old in made.values():
                old.unpersist()
            made.clear()
            minutes = lake.load_bars(spark, root, symbols, freq, start, end)
            funded = [s for s in symbols if os.path.isdir(os.path.join(root, "funding", f"symbol={s}"))]
            funding = lake.load_funding(spark, root, funded) if funded else None
            made[key] = sweep.prepare(minutes, freq, timeframe, funding, rows, funded).persist()
        return made[key]

    return load


def _revision() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or "unknown"
    except OSError:
        return "unknown"


def _outside(universe: str | None, symbols: set[str]) -> None:
    if universe and (extra := symbols - set(experiment.load_universe(universe).symbols)):
        raise ValueError(f"not in the universe: {', '.join(sorted(extra))}")


def ingest(a: argparse.Namespace) -> int:
    """Archives of a server with ``--base``, the months that the lake lacks of a universe's symbols; or files of a folder."""
    return ingest_archives(a) if a.base else ingest_files(a)


def ingest_archives(a: argparse.Namespace) -> int:
    if not a.universe:
        raise ValueError("--base needs --universe")
    universe, now = experiment.load_universe(a.universe), datetime.now(UTC)
    first, last = universe.start[:7], (universe.end or f"{now:%Y-%m}")[:7]
    say = lambda r: print(f"{r.symbol} {r.kind}: {r.error}" if r.error else f"{r.symbol} {r.kind}: fetched {r.fetched}, skipped {r.skipped}, absent {r.absent}, dropped rows {r.dropped_rows}{', ends early' * r.truncated}{', excluded' * r.excluded}", file=sys.stderr if r.error else sys.stdout)
    found = archives.ingest_symbols(session(), a.root, a.base, list(universe.symbols), a.freq, first, last, now, include_delisted=universe.include_delisted, force=a.force, done=say)
    return 1 if any(r.error for r in found) else 0


def ingest_files(a: argparse.Namespace) -> int:
    """Files named SYMBOL-*.csv or .zip below a folder, each symbol by itself: one that fails spoils no other."""
    spark, failed = session(), 0
    symbols = experiment.load_universe(a.universe).symbols if a.universe else sorted({os.path.basename(p).split("-")[0] for p in glob.glob(f"{a.files}/*")})
    for symbol in symbols:
        try:
            lines = klines.csv_lines(spark, f"{a.files}/{symbol}-*")
            if a.kind == "funding":
                lake.write_funding(klines.parse_funding(lines, symbol), a.root)
            else:
                found, dropped = klines.parse_klines(lines, symbol)
                lake.write_bars(found, a.root, a.freq)
                print(symbol, "dropped rows:", sum(r["dropped_rows"] for r in dropped.collect()))
        except Exception as e:
            failed += 1
            print(f"{symbol}: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    return 1 if failed else 0


def _prior(spark: SparkSession, path: str | None, cells: list[experiment.Cell]) -> int:
    if not path or not os.path.exists(path):
        return 0
    keys = [{"strategy": c.experiment.strategy, "params": c.experiment.params, "symbol": c.symbol, "timeframe": c.experiment.timeframe} for c in cells]
    return journal.prior_trials(journal.read_journal(spark, path), keys)


def _key(c: experiment.Cell) -> dict:
    return {"strategy": c.experiment.strategy, "params": c.experiment.params, "symbol": c.symbol, "timeframe": c.experiment.timeframe}


def run_cells(a: argparse.Namespace, cells: list[experiment.Cell], spark: SparkSession, load, version: str, causal: bool) -> dict[str, dict]:
    """Verdicts of the cells by config_id, new ones and those that the store had."""
    prior = 0 if a.ignore_journal else _prior(spark, a.journal, cells)
    notes = [causality.SKIPPED] if a.skip_causality else []
    for note in notes:
        print(f"warning: {note}", file=sys.stderr)
    counts = sweep.sweep(cells, load, a.store, spark, version, prior, a.screening, a.force, causal, notes, a.cut)
    rows = runs_store.read_runs(spark, a.store).where("error = ''")
    found = {r["config_id"]: r.asDict() for r in rows.where(rows["config_id"].isin([c.config_id for c in cells])).collect()}  # one grid's verdicts
    for r in found.values():
        print(f"{r['config_id']} {r['symbol']} sharpe {r['sharpe']:.3f} dsr {r['dsr']:.3f} p {r['p_value']:.3f} {'alive' if r['alive'] else r['reasons'] or r['warnings']}")
    print(json.dumps(counts))
    return found


def _record(a: argparse.Namespace, cells: list[experiment.Cell], found: dict[str, dict], version: str) -> None:
    """The trials of this call in the journal, each with its family."""
    if not a.journal or a.ignore_journal:
        return
    family = [experiment.canonical(_key(c)) for c in cells]
    records = []
    for c in cells:
        if r := found.get(c.config_id):
            eid = experiment.experiment_id(c.experiment, version, _revision())
            records.append({"key": _key(c), "experiment_id": eid, "sharpe": r["sharpe"], "dsr": r["dsr"], "alive": r["alive"], "family": family})
    journal.append(a.journal, records)


def validate(a: argparse.Namespace) -> int:
    """Verdicts of one experiment or a manifest on one symbol. A strategy that looks ahead stops the call before anything is
    run, stored or recorded. The report shows the manifest's first experiment, whatever the others give."""
    paths = experiment.load_manifest(a.configs) if a.configs else [a.config]
    found = [experiment.load_experiment(p) for p in paths]
    experiment.check_sweep(found)
    _outside(a.universe, {a.symbol})
    cells = [experiment.Cell(i, experiment.config_id(e, a.symbol), a.symbol, e) for i, e in enumerate(found)]
    spark, e = session(), found[0]
    version = lake.content_version(spark, a.root)
    load = loader(spark, a.root, rows=a.cut)
    prepared = load([a.symbol], e.timeframe, e.start, e.end)
    if not a.skip_causality:
        wrong = sweep.not_causal(prepared, sweep.hypotheses(cells), a.cut)
        if wrong:
            for c in cells:
                if c.config_id in wrong:
                    print(f"{c.experiment.name}: {wrong[c.config_id]}. Nothing was run; --skip-causality runs it all the same.", file=sys.stderr)
            return 1
    rows = run_cells(a, cells, spark, load, version, causal=False)
    if a.out and cells[0].config_id in rows:
        # The ledger of the first experiment once more: the sweep keeps verdicts, not curves.
        book = sweep.ledgers(prepared, sweep.hypotheses(cells[:1]), a.cut)
        extra = {"data_version": version, "causality_checked": not a.skip_causality, "configs": [{"name": c.experiment.name, "config_id": c.config_id, "params": c.experiment.params} for c in cells]}
        print("report:", *report_plan.write_report(report_plan.report(book, rows[cells[0].config_id], extra), a.out))
    _record(a, cells, rows, version)
    return 0


def grid(a: argparse.Namespace) -> int:
    """Verdicts of a grid; a cell that fails or looks ahead becomes an error row."""
    cells = experiment.load_grid(a.grid)
    _outside(a.universe, {c.symbol for c in cells})
    spark = session()
    version = lake.content_version(spark, a.root)
    _record(a, cells, run_cells(a, cells, spark, loader(spark, a.root, rows=a.cut), version, causal=not a.skip_causality), version)
    return 0


def report(a: argparse.Namespace) -> int:
    rows = runs_store.read_runs(session(), a.store)
    if a.data_version:
        rows = rows.where(rows["data_version"] == a.data_version)
    document = funnel.payload(rows, a.sort, a.top)
    if a.json:
        funnel.write_payload(document, a.json, a.js)
    print(json.dumps(document["funnel"], indent=1))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barforge")
    sub = p.add_subparsers(required=True)
    x = sub.add_parser("ingest", help="bring klines and funding into the lake, from files or a server's archives")
    x.set_defaults(run=ingest)
    where = x.add_mutually_exclusive_group(required=True)
    where.add_argument("--files", help="a folder of files")
    where.add_argument("--base", help="address of a server with monthly archives")
    x.add_argument("--force", action="store_true", help="download again what the lake has")
    x.add_argument("--kind", choices=["klines", "funding"], default="klines")
    x.add_argument("--freq", default="1m")
    x.add_argument("--root", required=True)
    x.add_argument("--universe")
    for name, run in (("validate", validate), ("sweep", grid)):
        x = sub.add_parser(name)
        x.set_defaults(run=run)
        if name == "validate":
            one = x.add_mutually_exclusive_group(required=True)
            one.add_argument("--config")
            one.add_argument("--configs", help="a manifest")
            x.add_argument("--symbol", required=True)
            x.add_argument("--out", help="folder of the report")
        else:
            x.add_argument("--grid", required=True)
        for option in ("--root", "--store"):
            x.add_argument(option, required=True)
        for option in ("--journal", "--universe"):
            x.add_argument(option)
        x.add_argument("--cut", type=int, help="bars in a chunk, for series that are too long for a task")
        for option in ("--screening", "--force", "--ignore-journal", "--skip-causality"):
            x.add_argument(option, action="store_true")
    x = sub.add_parser("report", help="the funnel of a results store")
    x.set_defaults(run=report)
    x.add_argument("--store", required=True)
    x.add_argument("--data-version")
    x.add_argument("--sort", default="sharpe", choices=list(funnel.SORTABLE))
    x.add_argument("--top", type=int, default=10)
    x.add_argument("--json")
    x.add_argument("--js")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
