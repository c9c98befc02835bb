import io
import json
import random
import zipfile
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barforge import cli
from barforge.plans import strategies, sweep
from barforge.sources import archive, experiment, journal, klines, lake, runs_store

from . import helpers


def test_day_and_instant_bounds(spark, tmp_path):
    minutes = helpers.bars(spark, [100 + (i % 7) for i in range(2880)], step=60)
    lake.write_bars(minutes.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path), "1m")
    n = lambda end: lake.load_bars(spark, str(tmp_path), "A", "1m", "2024-01-01", end).count()
    assert (n("2024-01-01"), n("2024-01-01T00:30"), n("2024-01-01T00:00")) == (1440, 31, 1)
    east = datetime(2024, 1, 1, 2, 30, tzinfo=timezone(timedelta(hours=2)))
    assert (n("2024-01-01T02:30+02:00"), n(east), n("2023-12-31T22:00-02:00"), n("2024-01-01T00:30Z")) == (31, 31, 1, 31)
    assert lake.load_bars(spark, str(tmp_path), "A", "1m", "2024-01-02T01:00+01:00").count() == 1440
    with pytest.raises(FileNotFoundError):
        lake.load_bars(spark, str(tmp_path), "B", "1m")
    with pytest.raises(FileNotFoundError):
        lake.load_bars(spark, str(tmp_path / "none"), "A", "1m")


def test_a_month_is_replaced_and_others_stay(spark, tmp_path):
    def month(m, price):
        return helpers.bars(spark, [price] * 3, step=86400, start=datetime(2024, m, 1)).withColumn("ts", F.col("ts").cast("timestamp"))

    for m, p in ((1, 10), (2, 20), (2, 30)):
        lake.write_bars(month(m, p), str(tmp_path), "1d")
    found = lake.load_bars(spark, str(tmp_path), "A", "1d")
    assert sorted({r["close"] for r in found.collect()}) == [10, 30]
    todo = lake.months_to_fetch(spark, str(tmp_path), "1d", ["A", "B"], "2024-01", "2024-03").collect()
    assert {tuple(r) for r in todo} == {("A", "2024-03"), ("B", "2024-01"), ("B", "2024-02"), ("B", "2024-03")}
    cut = lake.truncated_history(found, datetime(2024, 4, 9)).first()
    assert cut["missing_months"] == 1 and cut["ends_early"] and cut["truncated"]


def test_foreign_files_are_normalised_when_read(spark, tmp_path):
    rows = helpers.bars(spark, [10, 11, 12], step=86400).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.unionByName(rows).withColumn("close", F.when(F.dayofmonth("ts") < 3, F.col("close")).otherwise(float("nan"))).withColumns({"freq": F.lit("1d"), "month": F.date_format("ts", "yyyy-MM")})
    rows.write.partitionBy("symbol", "freq", "month").parquet(f"{tmp_path}/bars")
    assert lake.load_bars(spark, str(tmp_path), "A", "1d").count() == 6
    assert sorted(r["close"] for r in lake.read_bars(spark, str(tmp_path), "A", "1d").collect()) == [10, 11]


def test_symbols_need_bars_and_funding_in_every_month(spark, tmp_path):
    root = str(tmp_path)
    for s, last in (("A", 60), ("B", 30), ("C", 60)):
        lake.write_bars(helpers.bars(spark, [10] * last, symbol=s, step=86400).withColumn("ts", F.col("ts").cast("timestamp")), root, "1d")
    found = lambda: {r["symbol"]: tuple(r)[1:] for r in lake.discover_symbols(spark, root, "1d", "2024-01", "2024-02").collect()}
    assert found() == {"A": (0, 2, False), "B": (1, 2, False), "C": (0, 2, False)}
    day = lambda s, m, rate: (s, datetime(2024, m, 5), rate, 8)
    events = spark.createDataFrame([day("A", 1, 0.1), day("A", 1, 0.2), day("A", 2, 0.3), day("C", 1, 0.1), day("D", 1, 0.1)], "symbol string, ts timestamp, rate double, interval_hours long")
    lake.write_funding(events.coalesce(1), root)
    assert found() == {"A": (0, 0, True), "B": (1, 2, False), "C": (0, 1, False)}
    assert sorted(r["rate"] for r in lake.load_funding(spark, root, "A").collect()) == [0.2, 0.3]


def test_kline_files(spark, tmp_path):
    head = ",".join(klines.KLINE)
    row = lambda t, c: f"{t},1,2,0.5,{c},10,0,100,5,6,60,0"
    (tmp_path / "a.csv").write_text("\n".join([head, row(1704067200000, 1.5), row(1704067200000, 1.7), row("x", 1.5), row(1704067260000, "bad")]))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", row(1704067320000000, 1.9))
    found, dropped = klines.parse_klines(klines.csv_lines(spark, f"{tmp_path}/*"), "A")
    assert [(str(r["ts"]), r["close"]) for r in found.orderBy("ts").collect()] == [("2024-01-01 00:00:00", 1.7), ("2024-01-01 00:02:00", 1.9)]
    assert sorted(r["dropped_rows"] for r in dropped.collect()) == [0, 3]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.csv").write_text("calc_time,funding_interval_hours,last_funding_rate\n1704067200000,,0.0001\n1704067200000,4,0.0002\n1704070800000,8,\n")
    got = klines.parse_funding(klines.csv_lines(spark, f"{tmp_path}/f/*"), "A").collect()
    assert [(r["rate"], r["interval_hours"]) for r in got] == [(0.0002, 4)]
    for name, text in (("1.csv", "last_funding_rate,calc_time\n0.5,1704067200000\n"), ("2.csv", "1704070800000,4,0.25\n"), ("3.csv", "calc_time,rate\n1704070800000,1\n")):
        (tmp_path / "f" / name).write_text(text)
    got = klines.parse_funding(klines.csv_lines(spark, f"{tmp_path}/f/[12].csv"), "A").orderBy("ts").collect()
    assert [(r["rate"], r["interval_hours"]) for r in got] == [(0.5, 8), (0.25, 4)]
    with pytest.raises(Exception, match="no column last_funding_rate"):
        klines.parse_funding(klines.csv_lines(spark, f"{tmp_path}/f/3.csv"), "A").collect()


def test_archive_retries_and_ranges():
    waits, calls = [], []

    def flaky(url, headers):
        calls.append(headers)
        if len(calls) == 1:
            raise OSError("reset")
        return archive.Reply(503, headers={"Retry-After": "99"}) if len(calls) == 2 else archive.Reply(200, b"ok")

    assert archive.download(flaky, "u", sleep=waits.append) == b"ok" and waits[1] == 30.0 and 0.25 <= waits[0] <= 0.5
    assert archive.download(lambda u, h: archive.Reply(404), "u") is None
    with pytest.raises(OSError):
        archive.download(lambda u, h: archive.Reply(500), "u", tries=2)
    body = bytes(range(256)) * 200

    def ranged(url, headers):
        a, b = map(int, headers["Range"][6:].split("-"))
        return archive.Reply(206, body[a : b + 1])

    assert archive.download(ranged, "u", len(body)) == body
    asked = []

    def telling(url, headers):
        if "Range" not in headers:
            return archive.Reply(200, body)
        asked.append(headers["Range"])
        a, b = map(int, headers["Range"][6:].split("-"))
        return archive.Reply(206, body[a : b + 1], {"content-range": f"bytes {a}-{min(b, len(body) - 1)}/{len(body)}"})

    assert archive.download(telling, "u") == body and len(asked) == 9
    body = body[:100]
    assert archive.download(telling, "u") == body and len(asked) == 10
    assert archive.download(lambda u, h: archive.Reply(416) if h else archive.Reply(200, b""), "u") == b""
    assert archive.months("2023-11", "2024-02") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert archive.archive_url("http://h/", "A", "klines", "2024-01", "1m") == "http://h/monthly/klines/A/1m/A-1m-2024-01.zip"
    assert archive.wait_seconds(9, None, random.Random(0)) <= 30


def test_replies_that_are_tried_again():
    """One cut short, by an exception or by its length; waits that aren't whole seconds; archives that are none."""
    from http.client import IncompleteRead

    replies, waits = [IncompleteRead(b"o"), archive.Reply(200, b"o", {"content-length": "2"}), archive.Reply(429, headers={"Retry-After": "1.5"}), archive.Reply(200, b"ok", {"Content-Length": "2"})], []

    def fetch(url, headers):
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert archive.get(fetch, "u", sleep=waits.append).body == b"ok" and waits[2] == 1.5
    with pytest.raises(OSError, match="no usable reply"):
        archive.get(lambda u, h: archive.Reply(200, b"o", {"Content-Length": "2"}), "u", tries=2, sleep=waits.append)
    assert archive.wait_seconds(0, archive.Reply(503, headers={"Retry-After": "Wed, 21 Oct 2026 07:28:00 GMT"}), random.Random(0)) <= 0.5
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    for bad in (empty.getvalue(), b"", b"PK\x03\x04nothing"):
        with pytest.raises(OSError):
            list(archive.members(bad))


class FakeArchive(archive.ArchiveSource):
    @classmethod
    def name(cls):
        return "fake_archive"

    @staticmethod
    def fetch(url, headers):
        if "2024-02" in url:
            return archive.Reply(404)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("x.csv", "1,2\n3,4\n")
        return archive.Reply(200, data.getvalue())


def test_archive_source(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FakeArchive)
    rows = spark.read.format("fake_archive").options(base="http://h", symbols="A,B", first="2024-01", last="2024-02", freq="1m").load()
    assert {(r["symbol"], r["month"], r["line"]) for r in rows.collect()} == {(s, "2024-01", x) for s in "AB" for x in ("1,2", "3,4")}


def test_journal(spark, tmp_path):
    key = {"strategy": "s", "params": {"b": 1, "a": 2}, "symbol": "A", "timeframe": "1h"}
    path = str(tmp_path / "j.jsonl")
    journal.append(path, [{"key": key, "sharpe": 1.0}, {"key": {**key, "symbol": "B"}, "family": [journal.fingerprint(key)]}, {"key": {**key, "symbol": "C"}, "family": 5}])
    with open(path, "ab") as f:
        f.write(b"{broken\n[1]\n\xff\xfe\n\n")
    found = journal.read_journal(spark, path)
    assert journal.prior_trials(found, [{"timeframe": "1h", **key}]) == 2 and journal.skipped(found) == 3


def test_results_store(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runs_store.read_runs(spark, path).count() == 0
    rows = spark.createDataFrame([("a", 5, 0.5, True, ""), ("b", 7, float("nan"), True, " boom "), ("a", 9, 0.7, True, "")], "config_id string, trades int, dsr double, alive boolean, error string")
    runs_store.write_runs(rows.coalesce(1), path)
    runs_store.write_runs(spark.createDataFrame([("c", True, True)], "config_id string, alive boolean, screening boolean"), path)
    got = {r["config_id"]: r for r in runs_store.read_runs(spark, path).collect()}
    assert got["a"]["trades"] == 9 and got["b"]["trades"] == 0 and not got["b"]["alive"] and got["b"]["dsr"] is None and not got["c"]["alive"] and len(got) == 3
    with pytest.raises(ValueError, match="unknown"):
        runs_store.normalize_runs(spark.createDataFrame([("a", 1)], "config_id string, typo int"))
    with pytest.raises(Exception, match="config_id"):
        runs_store.normalize_runs(spark.createDataFrame([(" ",)], "config_id string")).collect()
    names = lambda: sorted(p.name for p in (tmp_path / "runs").iterdir())
    assert [n.split("-")[0] for n in names()] == ["_log", "delta", "delta"]
    (tmp_path / "runs" / f"delta-{'0' * 32}").mkdir()  # what a crash before the commit leaves
    assert runs_store.read_runs(spark, path).count() == 3
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "runs").rglob("*.parquet"))
    before = size()
    runs_store.write_runs(spark.createDataFrame([("d",)], "config_id string").coalesce(1), path)
    first = size() - before
    assert runs_store.read_runs(spark, path).count() == 4 and first > 0
    log = next((tmp_path / "runs" / "_log" / f"{1:012d}").iterdir())
    log.write_text(log.read_text().replace(runs_store.RUNS_VERSION, "9.0"))
    with pytest.raises(ValueError, match="version"):
        runs_store.read_runs(spark, path)


def test_store_grows_by_what_is_written_and_compacts(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "runs"), tmp_path / "runs"
    monkeypatch.setattr(runs_store, "COMPACT_AFTER", 4)
    write = lambda ids, trades: runs_store.write_runs(spark.createDataFrame([(i, trades) for i in ids], "config_id string, trades int").coalesce(1), path)
    write([f"c{i}" for i in range(2000)], 0)
    large = sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    for k in range(1, 4):
        before = {p for p in folder.rglob("*.parquet")}
        write([f"c{k}", f"new{k}"], k)
        assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before) < large / 2
    rows = lambda: {r["config_id"]: (r["trades"], r["seq"]) for r in runs_store.read_runs(spark, path).collect()}
    seen = rows()
    assert len(seen) == 2003 and [seen[f"c{k}"][0] for k in (1, 2, 3, 4)] == [1, 2, 3, 0] and seen["c1"][1] > seen["c1999"][1]
    write(["c1"], 9)  # the fifth table: merged into one, with the order of writes kept
    tables = runs_store.tables_of(runs_store._Folder(spark, path).commits())
    assert [n.split("-")[0] for n in tables] == ["merged"] and rows()["c1"][0] == 9 and {k: v for k, v in rows().items() if k != "c1"} == {k: v for k, v in seen.items() if k != "c1"}
    for k in range(12):
        write(["c5"], 100 + k)
    assert rows()["c5"][0] == 111 and len(rows()) == 2003
    assert len([p for p in folder.iterdir() if p.name != "_log"]) < 12 and len(list((folder / "_log").iterdir())) < 17


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(runs_store, "COMPACT_AFTER", 5)
    path = str(tmp_path / "runs")

    def write(w):
        for k in range(4):
            runs_store.write_runs(spark.createDataFrame([(f"w{w}-{k}", w), ("both", 10 * k + w)], "config_id string, trades int").coalesce(1), path)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    rows = {r["config_id"]: r["trades"] for r in runs_store.read_runs(spark, path).collect()}
    assert set(rows) == {"both", *(f"w{w}-{k}" for w in range(3) for k in range(4))} and rows["both"] in (30, 31, 32)


def test_a_commit_has_one_winner(spark, tmp_path):
    folder = runs_store._Folder(spark, str(tmp_path / "runs"))
    assert folder.commit(1, {"add": ["a"]}) and not folder.commit(1, {"add": ["b"]}) and folder.commit(2, {"add": ["c"]})
    assert {n: e["add"] for n, e in folder.commits().items()} == {1: ["a"], 2: ["c"]}
    assert sorted(p.name for p in (tmp_path / "runs" / "_log").iterdir()) == [f"{1:012d}", f"{2:012d}"]


GRID = """
experiment: {name: g, strategy: mean_reversion, timeframe: 1h, start: "2024-01-01", end: "2024-02-01", params: {k: 1.5}, validation: {n_permutations: 20}}
axes: {symbols: [A, B], timeframes: [1h], params: {window: [10, 20], tp_atr: [2.0, 3.0]}}
"""


def test_configuration_files(tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    cells = experiment.load_grid(file("g.yaml", GRID))
    assert [c.index for c in cells] == list(range(8)) and cells[1].experiment.params == {"k": 1.5, "window": 10, "tp_atr": 3.0} and len({c.config_id for c in cells}) == 8
    assert experiment.config_id(cells[0].experiment, "A") == cells[0].config_id
    for bad in (GRID.replace("axes:", "axis:"), GRID.replace("[A, B]", "[A, A]"), GRID.replace("[1h]", "[7h]"), GRID + "axes: {}\n"):
        with pytest.raises(ValueError):
            experiment.load_grid(file("bad.yaml", bad))
    u = experiment.load_universe(file("u.yaml", "market: m\nstart: 2024-01-01\nsymbols: [A]\ninclude_delisted:\n"))
    assert u.include_delisted and u.start == "2024-01-01"
    with pytest.raises(ValueError):
        experiment.load_universe(file("u2.yaml", "market: m\nstart: 2024-01-01\nsymbols: [A, A]\n"))
    file("e.yaml", "name: e\nstrategy: threshold\ntimeframe: 1h\nstart: 2024-01-01\n")
    assert experiment.load_manifest(file("m.txt", "e.yaml # first\n\n")) == [str(tmp_path / "e.yaml")]
    for bad in ("", "e.yaml\ne.yaml\n"):
        with pytest.raises(ValueError):
            experiment.load_manifest(file("m2.txt", bad))
    e = experiment.load_experiment(str(tmp_path / "e.yaml"))
    with pytest.raises(ValueError):
        experiment.check_sweep([e, e])


def test_sweep_resumes_and_isolates_faults(spark, tmp_path):
    x = helpers.ou(700, theta=0.1)
    prepared = {s: sweep.prepare(helpers.bars(spark, x + i, symbol=s), "1h", "1h").persist() for i, s in enumerate("AB")}
    (tmp_path / "g.yaml").write_text(GRID.replace("tp_atr: [2.0, 3.0]", "tp_atr: [2.0]"))
    cells = experiment.load_grid(str(tmp_path / "g.yaml"))
    bad = experiment.expand(cells[0].experiment, ["A"], ["1h"], {"typo": [1]})
    store = str(tmp_path / "runs")
    load = lambda symbols, *_: prepared["A"].unionByName(prepared["B"]).where(F.col("symbol").isin(symbols))
    assert sweep.sweep(cells + bad, load, store, spark, "v1") == {"cells": 5, "run": 5, "failed": 1}
    rows = {r["config_id"]: r for r in runs_store.read_runs(spark, store).collect()}
    assert len(rows) == 5 and "typo" in rows[bad[0].config_id]["error"] and all(rows[c.config_id]["n_trials"] == 5 and rows[c.config_id]["trades"] > 0 for c in cells)
    assert sweep.sweep(cells + bad, load, store, spark, "v1")["run"] == 1
    assert sweep.sweep(cells, load, store, spark, "v2")["run"] == 4


def test_a_group_is_judged_as_one_matrix(spark, tmp_path):
    """Twenty configurations in batches of eight; a faulty one changes nothing for the others, equal ones are a warning."""
    from barforge.functions import significance

    prepared = sweep.prepare(helpers.bars(spark, helpers.ou(260, theta=0.1)), "1h", "1h").persist()
    (tmp_path / "g.yaml").write_text(GRID.replace("mean_reversion", "threshold").replace("[10, 20], tp_atr: [2.0, 3.0]", f"{list(range(5, 24))}").replace("[A, B]", "[A]").replace("params: {k: 1.5}", "params: {k: 0.5}"))
    cells = experiment.load_grid(str(tmp_path / "g.yaml"))
    bad = experiment.expand(cells[0].experiment, ["A"], ["1h"], {"typo": [1]})
    before, sweep.BATCH = sweep.BATCH, 8
    try:
        assert sweep.sweep(cells + bad, lambda *_: prepared, str(tmp_path / "runs"), spark, "v1")["failed"] == 1
        twins = experiment.expand(cells[0].experiment, ["A"], ["1h"], {"k": [40.0, 50.0]})  # neither ever enters
        sweep.sweep(twins, lambda *_: prepared, str(tmp_path / "twins"), spark, "v1")
    finally:
        sweep.BATCH = before
    want = significance.overfitting(sweep.group_matrix([sweep.ledgers(prepared, sweep.hypotheses(cells))]).drop("symbol")).first()["pbo"]
    rows = [r for r in runs_store.read_runs(spark, str(tmp_path / "runs")).collect() if not r["error"]]
    assert len(rows) == 19 and want is not None and all(r["pbo"] == pytest.approx(want) for r in rows)
    assert all(r["pbo"] is None and "equal to another" in r["warnings"] for r in runs_store.read_runs(spark, str(tmp_path / "twins")).collect())
    assert not [p for p in tmp_path.iterdir() if "scratch" in p.name]


def test_symbols_of_a_group_are_one_plan(spark, tmp_path):
    """Each symbol has its own overfitting; one without bars or without funding fails alone."""
    from barforge.functions import significance

    x = {"A": helpers.ou(200, theta=0.1), "B": helpers.ou(200, theta=0.3, seed=5)}
    minutes = helpers.bars(spark, x["A"]).unionByName(helpers.bars(spark, x["B"], symbol="B"))
    funding = minutes.where("symbol = 'A'").select("symbol", "ts", (F.pmod(F.hash("ts"), F.lit(7)) / 1000 - 0.003).alias("rate"))
    prepared = sweep.prepare(minutes, "1h", "1h", funding, funded=["A"]).persist()
    base = experiment.Experiment("h", "threshold", {"k": 0.5}, "1h", "2024-01-01", validation={"n_permutations": 20})
    cells = experiment.expand(base, ["A", "B", "C"], ["1h"], {"window": [5, 10, 20]})
    cells += experiment.expand(replace(base, strategy="funding_harvest", params={}), ["A", "B"], ["1h"], {"window": [4]})
    assert [len(h.cells) for h in sweep.hypotheses(cells)] == [3, 3, 3, 2]
    counts = sweep.sweep(cells, lambda symbols, *_: prepared.where(F.col("symbol").isin(symbols)), str(tmp_path / "runs"), spark, "v1")
    rows = {r["config_id"]: r for r in runs_store.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert counts == {"cells": 11, "run": 11, "failed": 4} and len(rows) == 11
    for c in cells:
        r = rows[c.config_id]
        assert r["symbol"] == c.symbol and bool(r["error"]) == (c.symbol == "C" or (c.experiment.strategy, c.symbol) == ("funding_harvest", "B"))
        assert c.symbol != "C" or "no bars of C" in r["error"]
    for symbol in "AB":
        own = sweep.hypotheses([c for c in cells if c.symbol == symbol and not rows[c.config_id]["error"]])
        want = significance.overfitting(sweep.group_matrix([sweep.ledgers(prepared, own)]).drop("symbol")).first()["pbo"]
        assert all(rows[h.key]["pbo"] == pytest.approx(want) for h in own) and len(own) == (4 if symbol == "A" else 3)


class LooksAhead(strategies.Parametrised):
    name = "looks_ahead"
    defaults = {"k": 1}

    def generate(self, bars, within):
        from barforge.schema import by_time

        return bars.withColumn("target", F.coalesce(F.signum(F.lead("close", int(self.k)).over(by_time(within)) - F.col("close")), F.lit(0.0)))


@pytest.fixture
def looks_ahead():
    strategies.register(LooksAhead)
    yield
    del strategies.REGISTRY["looks_ahead"]


def test_sweep_makes_an_error_row_of_what_looks_ahead(spark, tmp_path, looks_ahead):
    prepared = sweep.prepare(helpers.bars(spark, helpers.ou(300, theta=0.1)), "1h", "1h").persist()
    honest = experiment.Experiment("h", "threshold", {"window": 10}, "1h", "2024-01-01", validation={"n_permutations": 20})
    cells = experiment.expand(honest, ["A"], ["1h"], {"window": [10, 20]}) + experiment.expand(replace(honest, strategy="looks_ahead", params={}), ["A"], ["1h"], {"k": [1, 2]})
    run = lambda name, **o: (sweep.sweep(cells, lambda *_: prepared, str(tmp_path / name), spark, "v1", **o), {r["config_id"]: r for r in runs_store.read_runs(spark, str(tmp_path / name)).collect()})
    counts, rows = run("runs")
    assert counts == {"cells": 4, "run": 4, "failed": 2} and len(rows) == 4
    assert all("CausalityError" in rows[c.config_id]["error"] and "not causal" in rows[c.config_id]["error"] and not rows[c.config_id]["alive"] for c in cells[2:])
    assert all(not rows[c.config_id]["error"] and rows[c.config_id]["pbo"] is not None for c in cells[:2])
    counts, rows = run("unchecked", causal=False, notes=["not checked"])
    assert counts["failed"] == 0 and all("not checked" in r["warnings"] for r in rows.values())


def test_validate_stops_at_what_looks_ahead(spark, tmp_path, capsys, looks_ahead):
    root, store, out = str(tmp_path / "lake"), str(tmp_path / "runs"), tmp_path / "report"
    lake.write_bars(helpers.bars(spark, helpers.ou(300, theta=0.1)).withColumn("ts", F.col("ts").cast("timestamp")), root, "1m")
    (tmp_path / "good.yaml").write_text("name: good\nstrategy: threshold\ntimeframe: 1h\nstart: '2024-01-01'\nvalidation: {n_permutations: 20}\n")
    (tmp_path / "bad.yaml").write_text("name: bad\nstrategy: looks_ahead\ntimeframe: 1h\nstart: '2024-01-01'\nvalidation: {n_permutations: 20}\n")
    (tmp_path / "m.txt").write_text("good.yaml\nbad.yaml\n")
    run = ["validate", "--configs", str(tmp_path / "m.txt"), "--symbol", "A", "--root", root, "--store", store, "--journal", str(tmp_path / "j"), "--out", str(out)]
    assert cli.main(run) == 1
    assert "bad: looks_ahead on A: not causal" in capsys.readouterr().err and not out.exists() and not (tmp_path / "j").exists()
    assert runs_store.read_runs(spark, store).count() == 0
    assert cli.main([*run, "--skip-causality"]) == 0
    assert "not checked" in capsys.readouterr().err
    document = json.loads((out / "report.json").read_text())
    assert document["extra"]["causality_checked"] is False and "not checked" in document["run"]["warnings"] and len((tmp_path / "j").read_text().splitlines()) == 2
    assert cli.main(["validate", "--config", str(tmp_path / "good.yaml"), *run[3:], "--force"]) == 0
    document = json.loads((out / "report.json").read_text())
    assert document["extra"]["causality_checked"] is True and document["run"]["strategy"] == "threshold" and "not checked" not in document["run"]["warnings"]
    assert len(document["ts"]) == 300 == len(document["equity"]) == len(document["funding"]) and document["equity"][0] == 1.0
    assert (out / "report.js").read_text() == "window.REPORT = " + (out / "report.json").read_text() + ";\n"


@pytest.fixture
def server():
    """Archives of A and B from 2024-01 to 2024-03 and two months of funding; each request is noted."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked, broken = [], set()

    class Archives(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, symbol, month = self.path.split("/")[2], self.path.split("/")[3], self.path[-11:-4]
            asked.append((kind, symbol, month))
            start = datetime(int(month[:4]), int(month[5:]), 1, tzinfo=timezone.utc)
            ms = [int((start + timedelta(hours=8 * i)).timestamp() * 1000) for i in range(84)]
            out, name = io.BytesIO(), f"{symbol}-{month}.csv"
            with zipfile.ZipFile(out, "w") as z:
                if kind == "klines":
                    z.writestr(name, "\n".join(f"{t},100,101,99,100.5,10,0,1000,5,6,60,0" for t in ms))
                else:
                    z.writestr(name, "calc_time,funding_interval_hours,last_funding_rate\n" + "\n".join(f"{t},8,0.0001" for t in ms))
            known = symbol in "AB" and "2024-01" <= month <= ("2024-03" if kind == "klines" else "2024-02")
            body = b"no zip" if (symbol, month) in broken else out.getvalue() if known else b""
            self.send_response(200 if known else 404)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Archives)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked, broken
    http.shutdown()


def test_ingest_downloads_what_the_lake_lacks(spark, tmp_path, server, capsys):
    base, asked, broken = server
    root, universe = str(tmp_path / "lake"), tmp_path / "u.yaml"
    universe.write_text("market: m\nstart: 2024-01-01\nend: 2024-02-28\nsymbols: [A]\n")
    run = ["ingest", "--base", base, "--universe", str(universe), "--root", root, "--freq", "1m"]
    assert cli.main(run) == 0
    assert sorted(asked) == [(k, "A", m) for k in ("fundingRate", "klines") for m in ("2024-01", "2024-02")]
    asked.clear()
    universe.write_text("market: m\nstart: 2024-01-01\nend: 2024-04-30\nsymbols: [A, B, Z]\n")
    broken.add(("B", "2024-02"))
    assert cli.main(run) == 1  # B has a damaged archive; A and Z are none the worse
    bars = [(s, m) for k, s, m in asked if k == "klines"]
    assert [m for s, m in sorted(bars) if s == "A"] == ["2024-03", "2024-04"] and {m for s, m in bars if s == "Z"} == {f"2024-0{i}" for i in range(1, 5)}
    assert [m for k, s, m in sorted(asked) if (k, s) == ("fundingRate", "A")] == ["2024-03", "2024-04"]
    said = capsys.readouterr()
    assert "B klines: " in said.err and "A klines: fetched 1, skipped 2, absent 1" in said.out and "Z klines: fetched 0, skipped 0, absent 4" in said.out
    assert lake.load_bars(spark, root, "A", "1m").count() == 3 * 84 and lake.load_funding(spark, root, "A").count() == 2 * 84
    broken.clear()
    asked.clear()
    assert cli.main(run) == 0 and lake.load_bars(spark, root, "B", "1m").count() == 3 * 84
    assert not [p for p in (tmp_path / "lake").iterdir() if "staging" in p.name]
    asked.clear()
    assert cli.main([*run, "--force"]) == 0 and ("klines", "A", "2024-01") in asked


def test_filters_go_down_to_the_archive_source():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = archive._FilteredReader({"base": "b", "symbols": "A,B", "first": "2024-01", "last": "2024-04"}, None)
    assert len(reader.partitions()) == 8
    left = list(reader.pushFilters([EqualTo(("symbol",), "B"), In(("month",), ("2024-02", "2024-09")), GreaterThan(("line_no",), 3)]))
    assert left == [GreaterThan(("line_no",), 3)] and [p.value for p in reader.partitions()] == [("B", "2024-02")]
    list(reader.pushFilters([EqualTo(("month",), "2024-03")]))
    assert [p.value for p in reader.partitions()] == [("", "")] and list(reader.read(reader.partitions()[0])) == []


def test_symbols_whose_history_ends_early_can_be_left_out(spark, tmp_path, server):
    from barforge.sources import ingest

    base, _, _ = server
    run = lambda root, **o: ingest.ingest_symbols(spark, str(tmp_path / root), base, ["A"], "1m", "2024-01", "2024-08", datetime(2024, 9, 3), **o)
    (bars,) = run("without", include_delisted=False)
    assert bars.truncated and bars.excluded and bars.absent == 5 and not (tmp_path / "without" / "bars").exists()
    bars, funding = run("with")
    assert bars.truncated and not bars.excluded and lake.load_bars(spark, str(tmp_path / "with"), "A", "1m").count() == 252 and funding.fetched == 2


def test_content_version_follows_the_rows(spark, tmp_path):
    import shutil

    from barforge.sources.experiment import Experiment, experiment_id

    root = str(tmp_path / "lake")
    assert lake.content_version(spark, root) == "empty"
    df = helpers.bars(spark, range(100, 200), step=86400).withColumn("ts", F.col("ts").cast("timestamp"))
    lake.write_bars(df, root, "1d")
    lake.write_funding(df.select("symbol", "ts", F.lit(0.001).alias("rate"), F.lit(8).cast("long").alias("interval_hours")), root)
    first = lake.content_version(spark, root)
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("_content*"))
    assert lake.content_version(spark, str(tmp_path / "copy")) == first == lake.content_version(spark, root)
    lake.write_bars(df.where("month(ts) = 2").repartition(3), root, "1d")  # the same rows in another file
    kept = json.loads((tmp_path / "lake" / "_content.json").read_text())
    assert lake.content_version(spark, root) == first and set(json.loads((tmp_path / "lake" / "_content.json").read_text())) != set(kept)
    lake.write_bars(df.where("month(ts) = 2").withColumn("volume", F.when(F.col("close") == 140, F.lit(None)).otherwise(F.col("volume"))), root, "1d")
    changed = lake.content_version(spark, root)
    assert changed != first and lake.content_version(spark, root, keep=False) == changed
    (tmp_path / "lake" / "_content.json").write_text("{cut off")
    assert lake.content_version(spark, root) == changed
    e = Experiment("e", "threshold", {"k": 1}, "1d", "2024-01-01")
    assert experiment_id(e, first, "r") == experiment_id(replace(e), first, "r") and len({experiment_id(e, first, "r"), experiment_id(e, changed, "r"), experiment_id(e, first, "s"), experiment_id(replace(e, name="f"), first, "r")}) == 4


def test_command_line(spark, tmp_path, capsys):
    rows = ["{},{},{},{},{},10,0,100000000,5,6,60,0".format(1704067200000 + 3600000 * i, c, c + 1, c - 1, c) for i, c in enumerate(helpers.ou(400, theta=0.1))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A-1h.csv").write_text("\n".join(rows))
    root, store = str(tmp_path / "lake"), str(tmp_path / "runs")
    assert cli.main(["ingest", "--files", str(tmp_path / "in"), "--root", root, "--freq", "1m"]) == 0
    (tmp_path / "e.yaml").write_text("name: e\nstrategy: threshold\ntimeframe: 1h\nstart: '2024-01-01'\nvalidation: {n_permutations: 20}\n")
    run = ["validate", "--config", str(tmp_path / "e.yaml"), "--symbol", "A", "--root", root, "--store", store, "--journal", str(tmp_path / "j")]
    assert cli.main(run) == 0 and cli.main([*run, "--force"]) == 0
    assert runs_store.read_runs(spark, store).first()["n_trials"] == 2
    assert cli.main(["report", "--store", store, "--json", str(tmp_path / "f.json"), "--js", str(tmp_path / "f.js")]) == 0
    assert json.loads((tmp_path / "f.json").read_text())["funnel"]["n"] == 1 and (tmp_path / "f.js").read_text().startswith("window.FUNNEL = ")
    assert "sharpe" in capsys.readouterr().out
