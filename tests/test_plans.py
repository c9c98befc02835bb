import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barforge.functions import metrics, significance
from barforge.operators import bars as B
from barforge.plans import causality, funnel, ledger, portfolio, search, strategies, verdict
from barforge.schema import by_time

from . import helpers

K = ["symbol"]


def with_target(spark, closes, target, **options):
    df = helpers.bars(spark, closes, **options)
    values = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(target)], "n int, target double")
    return df.withColumn("n", F.row_number().over(by_time(K))).join(values, "n").drop("n")


def test_cost_free_ledger_by_hand(spark):
    out = ledger.ledger(with_target(spark, [100, 110, 99, 99], [1, -1, 0, 0]), K, ledger.FREE).orderBy("ts").collect()
    assert [r["held"] for r in out] == [0, 1, -1, 0]
    assert [round(r["returns"], 12) for r in out] == [0, 0.1, 0.1, 0]
    assert out[-1]["equity"] == pytest.approx(1.21) and out[-1]["turnover"] == 1


def test_round_trip_pays_twice(spark):
    costs = ledger.Costs(taker_fee_bps=5, min_slippage_bps=0.5, impact_coef=0.0)
    out = ledger.ledger(with_target(spark, [100] * 4, [1, 0, 0, 0]), K, costs)
    assert out.agg(F.sum("returns")).first()[0] == pytest.approx(-1.1e-3)
    assert ledger.trade_returns(out, K).first()["trade_return"] == pytest.approx(-1.1e-3)


def test_trades_and_episodes_add_up(spark):
    rng = np.random.default_rng(1)
    target = rng.choice([-1, -0.5, 0, 0, 1], 300)
    out = ledger.ledger(with_target(spark, 100 + rng.random(300).cumsum(), target), K).cache()
    total = out.agg(F.sum("returns")).first()[0]
    assert ledger.trade_returns(out, K).agg(F.sum("trade_return")).first()[0] == pytest.approx(total, abs=1e-12)
    assert ledger.episodes(out, K).agg(F.sum("net_return")).first()[0] == pytest.approx(total, abs=1e-12)


def test_dearer_costs_never_pay(spark):
    df = with_target(spark, [100, 101, 99, 103, 100], [1, -1, 1, 0, 0])
    end = lambda **c: ledger.totals(ledger.ledger(df, K, ledger.Costs(**c)), K).first()["equity_end"]
    assert end(taker_fee_bps=1) > end(taker_fee_bps=5) > end(taker_fee_bps=5, min_slippage_bps=9)
    assert ledger.Costs.from_config({"taker_fee_bps": None, "other": 1}).fee_bps == 5


def test_two_legs_carry_funding(spark):
    df = helpers.bars(spark, [100] * 6).withColumn("funding_rate", F.lit(0.001))
    run = strategies.make("funding_harvest", {"window": 2, "weight": 0.5}).generate(df, K)
    out = ledger.ledger(run, K, ledger.Costs(impact_coef=0.0), legs=True).cache()
    assert out.agg(F.sum("funding")).first()[0] == pytest.approx(-0.5 * 0.001 * 4)
    assert ledger.is_delta_neutral(out, K).first()["delta_neutral"] and ledger.trade_returns(out, K).count() == 0
    assert portfolio.sleeve_faults(out, K, 0.5).count() == 0
    with pytest.raises(Exception, match="not finite"):
        strategies.make("funding_harvest").generate(df.withColumn("funding_rate", F.lit(None).cast("double")), K).collect()


def test_capacity(spark):
    out = ledger.totals(ledger.ledger(with_target(spark, [100] * 3, [1, 0, 0], quote=1000.0), K, capital=500.0, max_participation=0.25), K).first()
    assert out["cap_hits"] == 2 and out["over_capacity"] and out["max_participation_observed"] == 0.5


def test_metrics_by_hand(spark):
    e = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 1.2, 0.9, 1.0, 1.5])], "symbol string, ts int, equity double")
    assert metrics.with_drawdown(e, K).agg(metrics.max_drawdown()).first()[0] == pytest.approx(-0.25)
    t = spark.createDataFrame([("A", v) for v in [0.05, -0.02, 0.03, -0.01]], "symbol string, trade_return double")
    row = metrics.trade_summary(t, K).first()
    assert row["profit_factor"] == pytest.approx(8 / 3) and row["win_rate"] == 0.5 and row["trades"] == 4
    flat = spark.createDataFrame([(0.01,)] * 5, "r double")
    assert flat.agg(metrics.sharpe("r")).first()[0] == 0.0 and flat.agg(metrics.sortino("r")).first()[0] == math.inf


def returns(spark, values, name="A"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "symbol string, ts int, returns double")


def test_deflated_sharpe_against_numpy(spark):
    from statistics import NormalDist

    r = np.random.default_rng(3).normal(0.05, 1, 500)
    got = [significance.deflated_sharpe(returns(spark, r), K, n).first()["dsr"] for n in (1, 10, 100)]
    sr, d = r.mean() / r.std(ddof=1), r - r.mean()
    skew, kurt = (d**3).mean() / r.std() ** 3, (d**4).mean() / r.std() ** 4
    nd = NormalDist()
    for n, g in zip((1, 10, 100), got, strict=True):
        best = 0 if n == 1 else (1 - significance.EULER) * nd.inv_cdf(1 - 1 / n) + significance.EULER * nd.inv_cdf(1 - 1 / (n * math.e))
        sr0 = best * math.sqrt((1 + 0.5 * sr * sr) / 500)
        assert g == pytest.approx(nd.cdf((sr - sr0) * math.sqrt(499) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)), abs=1e-9)
    assert got[0] > got[1] > got[2]
    assert significance.deflated_sharpe(returns(spark, [0.0] * 9), K, 5).first()["dsr"] == 0.0
    with pytest.raises(ValueError):
        significance.expected_best(0)


def plain_pbo(m, blocks=10):
    from itertools import combinations

    size = len(m) // blocks
    b = m[: size * blocks].reshape(blocks, size, m.shape[1])
    sr = lambda x: x.mean(0) / x.std(0, ddof=1)
    below = []
    for tr in combinations(range(blocks), blocks // 2):
        te = [i for i in range(blocks) if i not in tr]
        a, z = sr(b[list(tr)].reshape(-1, m.shape[1])), sr(b[te].reshape(-1, m.shape[1]))
        rank = pd.Series(z).rank().to_numpy()
        below.append(rank[int(a.argmax())] / (m.shape[1] + 1) < 0.5)
    return float(np.mean(below))


def test_overfitting_against_numpy(spark):
    for seed, edge in ((0, 0.0), (1, 0.15)):
        m = np.random.default_rng(seed).normal(0, 1, (203, 6))
        m[:, 0] += edge
        rows = [(f"c{j}", i, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)]
        df = spark.createDataFrame(rows, "config_id string, ts int, ret double")
        assert significance.overfitting(df).first()["pbo"] == pytest.approx(plain_pbo(m))
    assert significance.overfitting(df.where("config_id = 'c0'")).first()["pbo"] is None
    assert significance.overfitting(df, 5).first()["pbo"] is None


def test_permutations(spark):
    rng = np.random.default_rng(5)
    price = rng.normal(0, 0.01, 300)
    good = np.sign(price)
    assert significance.permutation_p(price, good, 200) == pytest.approx(1 / 201)
    assert significance.permutation_p(price, np.zeros(300)) == 1.0 and significance.permutation_p(price[:5], good[:5]) == 1.0
    df = spark.createDataFrame([("A", i, float(p), float(h)) for i, (p, h) in enumerate(zip(price, good, strict=True))], "symbol string, ts int, price_return double, held double")
    assert significance.permutation_test(df, K, 200).first()["p_value"] == significance.permutation_p(price, good, 200)


def test_purged_folds(spark):
    df = returns(spark, range(20))
    found = {(r["fold"], r["role"]): sorted(r["i"]) for r in significance.purged_folds(df, K, 4, 2, 3).groupBy("fold", "role").agg(F.collect_list("ts").alias("i")).collect()}
    assert found[(1, "test")] == list(range(5, 10)) and found[(1, "train")] == [0, 1, 2, 13, 14, 15, 16, 17, 18, 19]
    assert found[(0, "train")] == list(range(8, 20))


def test_filters_off_is_the_base_strategy(spark):
    df = helpers.bars(spark, helpers.ou(800, theta=0.1))
    base = strategies.make("mean_reversion", {"k": 1.5}).generate(df, K).select("ts", "target").orderBy("ts").collect()
    same = strategies.make("mean_reversion_filtered", {"k": 1.5}).generate(df, K).select("ts", "target").orderBy("ts").collect()
    assert base == same and any(r["target"] for r in base)
    tight = strategies.make("mean_reversion_filtered", {"k": 1.5, "adx_max": 15, "quantile_window": 100, "squeeze_ratio": 1.0, "use_hl_filter": True}).generate(df, K)
    assert tight.where("target <> 0").count() < sum(r["target"] != 0 for r in base)
    with pytest.raises(ValueError):
        strategies.make("mean_reversion", {"typo": 1})


class Peeks(strategies.Parametrised):
    name = "peeks"

    def generate(self, bars, within):
        return bars.withColumn("target", F.coalesce(F.signum(F.lead("close").over(by_time(within)) - F.col("close")), F.lit(0.0)))


def test_causality(spark):
    df = helpers.bars(spark, helpers.ou(60, theta=0.2))
    for honest in (strategies.make("threshold", {"window": 5}), strategies.make("mean_reversion", {"window": 5, "atr_len": 3, "k": 1.0})):
        assert causality.leaks(honest, df, K).count() == 0
    assert causality.leaks(Peeks(), df, K).count() > 50
    assert causality.looks_ahead(Peeks().generate(df, K)) and not causality.looks_ahead(strategies.make("threshold").generate(df, K))
    assert causality.cuts(5) == [2, 3, 4] and causality.cuts(2) == [] and len(causality.cuts(35064)) < 220 and causality.cuts(35064)[-1] == 35063
    for n in (2, 3, 5, 600, 601, 1207, 35064):
        got = spark.range(1).select(causality.cuts_of(F.lit(n)).alias("c")).first()["c"]
        assert got == causality.cuts(n)


class LastOnly(strategies.Parametrised):
    """Looks ahead on the bar before the last alone: only the cut at n - 1 shows it."""

    name = "last_only"

    def generate(self, bars, within):
        following = F.lead("close").over(by_time(within))
        return bars.withColumn("target", F.when(F.lead("close", 2).over(by_time(within)).isNull() & (following > 0), 1.0).otherwise(0.0))


class FarAhead(strategies.Parametrised):
    """A window strategy by its own word, with a look far beyond its memory."""

    name = "far_ahead"
    recursive = False
    history = 3

    def generate(self, bars, within):
        return bars.withColumn("target", F.when(F.lead("close", 40).over(by_time(within)) > 100, 1.0).otherwise(0.0))


class Forgetful(strategies.Parametrised):
    """Reads nine bars and says three."""

    name = "forgetful"
    recursive = False
    history = 3

    def generate(self, bars, within):
        return bars.withColumn("target", F.when(F.sum("close").over(by_time(within).rowsBetween(-8, 0)) > 900, 1.0).otherwise(0.0))


def test_audit_of_window_and_recursive_strategies(spark):
    """All strategies in one plan over long and short series; what is cut to its memory judges as whole prefixes do."""
    df = helpers.bars(spark, helpers.ou(1300, theta=0.2)).unionByName(helpers.bars(spark, [100, 101], symbol="short")).withColumn("funding_rate", F.lit(0.001))
    tried = {
        "threshold": strategies.make("threshold", {"window": 7}), "harvest": strategies.make("funding_harvest", {"window": 5}),
        "peeks": Peeks(), "last": LastOnly(), "far": FarAhead(), "forgetful": Forgetful(),
    }
    rows = {(r["config_id"], r["symbol"]): r for r in causality.audit(tried, df, K).collect()}
    assert len(rows) == 12 and all(rows[c, "short"]["n_cuts"] == 0 for c in tried) and rows["peeks", "A"]["n_cuts"] == len(causality.cuts(1300))
    assert {c for c in tried if rows[c, "A"]["cut"] is not None} == {"peeks", "last", "far", "forgetful"}
    said = causality.failures(tried, df.where("symbol = 'A'"), K)
    assert set(said) == {(c, "A") for c in ("peeks", "last", "far", "forgetful")} and "not causal" in said["last", "A"]
    assert "too few bars" in causality.failures({"t": tried["threshold"]}, df.where("symbol = 'short'"), K)["t", "short"]


def test_rows_of_the_harness_follow_the_memory(spark):
    df = helpers.bars(spark, helpers.ou(1300, theta=0.2))
    n = {w: causality.compared(strategies.make("threshold", {"window": w}), df, K).count() for w in (5, 10)}
    assert n[5] <= len(causality.cuts(1300)) * 10 and n[10] <= len(causality.cuts(1300)) * 20


@pytest.mark.parametrize(("theta", "alive"), [(0.02, True), (0.002, False)])
def test_strong_reversion_lives_and_weak_dies(spark, theta, alive):
    x = helpers.ou(20_000, theta=theta)
    half = 0.5
    before = np.concatenate([[x[0]], x[:-1]])
    ts = pd.date_range("2020-01-01", periods=len(x), freq="h")
    frame = pd.DataFrame({"symbol": "A", "ts": ts, "open": before, "high": np.maximum(before, x) + half, "low": np.minimum(before, x) - half, "close": x, "volume": 1e7, "quote_volume": 1e7 * x, "trades": 5.0})
    df = spark.createDataFrame(frame, T.StructType.fromDDL("symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades double"))
    run = strategies.run_segmented(strategies.make("mean_reversion"), B.with_segments(df, K, 3600), K)
    book = ledger.ledger(run, K).cache()
    row = verdict.verdicts(book, ledger.trade_returns(book, K), K, 1, 8760.0, thresholds={"n_permutations": 200}).first()
    assert row["alive"] is alive, row
    assert row["warnings"] == [verdict.NO_PBO]


def test_gates_that_mean_nothing_for_a_book(spark):
    rows = [("A", i, 0.0, 0.0, float(1e-4 + 2e-4 * e), 0.0, 0.0, 0.0) for i, e in enumerate(np.random.default_rng(0).standard_normal(500))]
    df = spark.createDataFrame(rows, "symbol string, ts int, held double, price_return double, returns double, fee double, slippage double, funding double")
    df = metrics.with_drawdown(df.withColumn("equity", F.product(1 + F.col("returns")).over(by_time(K).rowsBetween(-10**6, 0))), K)
    none = spark.createDataFrame([], "symbol string, trade_id long, trade_return double")
    row = verdict.verdicts(df, none, K, 1, 8760.0).withColumn("status", verdict.status()).first()
    assert row["inapplicable"] == [verdict.NO_EXPOSURE, verdict.NO_DIRECTION] and not row["alive"] and row["status"] == "not rendered"
    assert verdict.verdicts(df, none, K, 1, 8760.0, screening=True).first()["n_permutations"] == 200


def test_funnel_counts(spark):
    gate = '{"min_trades": 100, "min_dsr": 0.95, "max_p_value": 0.05, "max_pbo": 0.5}'
    row = lambda i, trades, dsr, p, pbo, alive=False, error="": (f"c{i}", "A", "1h", trades, dsr, p, pbo, 1.0 * i, error, False, alive, 1000, gate, "", i)
    rows = [row(0, 10, 0.99, 0.01, 0.1)] + [row(i, 200, 0.5, 0.01, 0.1) for i in (1, 2)] + [row(i, 200, 0.99, 0.2, 0.1) for i in (3, 4, 5)]
    rows += [row(i, 200, 0.99, 0.01, 0.9) for i in (6, 7, 8)] + [row(9, 200, 0.99, 0.01, None, True)] + [row(i, 200, 0.99, 0.01, 0.1, True) for i in (10, 11)]
    rows += [row(i, 0, None, None, None, error="boom") for i in (12, 13)]
    schema = "config_id string, symbol string, timeframe string, trades long, dsr double, p_value double, pbo double, sharpe double, error string, screening boolean, alive boolean, n_permutations long, thresholds_json string, reasons string, seq long"
    df = spark.createDataFrame(rows, schema)
    r = funnel.funnel(df).first()
    assert [r[c] for c in ("n", "n_trades", "n_dsr", "n_p_value", "n_pbo", "n_alive", "alive_without_pbo")] == [12, 11, 9, 6, 2, 2, 1]
    d = funnel.payload(df)
    assert [x["config_id"] for x in d["survivors"]] == ["c11", "c10"] and d["errors"] == 2 and d["screening"] is None
    assert funnel.payload(df.where("not alive"))["survivors"] is None
    broken = df.withColumn("thresholds_json", F.lit('{"min_trades": 1}'))
    assert funnel.funnel(broken).first()["thresholds_unknown"] == 12
    assert d["funnel"]["thresholds"] == {"min_trades": 100, "min_dsr": 0.95, "max_p_value": 0.05, "max_pbo": 0.5, "mixed": False} and d["warnings"] == []
    other = df.withColumn("thresholds_json", F.when(F.col("seq") == 3, gate.replace("100", "50")).otherwise(F.col("thresholds_json"))).withColumn("screening", F.col("seq").isin(1, 2))
    m = funnel.payload(other)
    assert m["funnel"]["thresholds"]["mixed"] and m["funnel"]["steps"][0]["threshold"] is None and m["funnel"]["steps"][1]["threshold"] == 0.95
    assert [w.split(":")[0] for w in m["warnings"]] == ["mixed grades", "mixed thresholds among the full verdicts"]
    assert funnel.payload(df.where("false"))["funnel"]["thresholds"]["min_trades"] == 100


def test_ledger_refuses_what_it_cannot_judge(spark):
    with pytest.raises(Exception, match="fewer than two bars"):
        ledger.totals(ledger.ledger(with_target(spark, [100], [1]), K), K).collect()
    assert ledger.ledger(with_target(spark, [100, 100], [1, 1]), K).count() == 2
    legs = with_target(spark, [100, 101, 102], [1, 1, 1]).withColumns({"net": F.lit(0.0), "gross": F.lit(1.0), "carry": F.lit(-1.0)})
    for leg in ("gross", "carry"):
        for bad in (None, float("nan"), float("inf")):
            with pytest.raises(Exception, match=f"{leg} is not finite"):
                ledger.ledger(legs.withColumn(leg, F.lit(bad).cast("double")).withColumn("funding_rate", F.lit(0.001)), K, legs=True).collect()


def test_portfolio(spark):
    a, b = with_target(spark, [100, 110, 121], [1, 1, 1]), with_target(spark, [100, 90, 81], [0, 0, 0], symbol="B")
    out = portfolio.equal_weight(ledger.ledger(a.unionByName(b), K, ledger.FREE), "symbol").orderBy("ts").collect()
    assert [round(r["returns"], 9) for r in out] == [0, 0.05, 0.05] and [r["in_book"] for r in out] == [0, 1, 1]
    assert portfolio.sleeve_notional(1) == 0.5
    with pytest.raises(ValueError):
        portfolio.sleeve_notional(0)


def test_search_is_repeatable_and_finds_the_top(spark):
    axes = {"a": [1, 2, 3, 4, 5], "b": [10, 20, 30]}
    asked = []

    def evaluate(params):
        asked.extend(map(search.key, params))
        return spark.createDataFrame([(search.key(p), s, float(-abs(p["a"] - 4) - abs(p["b"] - 20) / 10)) for p in params for s in "xy"], "params_json string, symbol string, sharpe double")

    found = search.search(evaluate, axes, epochs=6, size=6)
    assert found[-1]["params"] == {"a": 4, "b": 20} and len(asked) == len(set(asked))
    assert found == search.search(evaluate, axes, epochs=6, size=6)


def test_r_multiples(spark):
    from barforge.operators import kernels

    df = helpers.bars(spark, helpers.ou(600, theta=0.1))
    run = strategies.make("mean_reversion", {"k": 1.2, "max_bars": 10}).generate(df, K)
    rows = kernels.bracket_trades(run, K, 2.0, 3.0, 10).collect()
    assert rows and {r["reason"] for r in rows} <= {"stop", "take", "time", "open"}
    assert all(r["r"] == pytest.approx(-1) for r in rows if r["reason"] == "stop") and all(r["r"] == pytest.approx(1.5) for r in rows if r["reason"] == "take")
    assert metrics.r_statistics(kernels.bracket_trades(run, K, 2.0, 3.0, 10), K).first()["trades"] == len(rows)


def test_curve(spark):
    df = with_target(spark, [100, 110, 121], [1, 1, 1], step=86400, start=datetime(2024, 1, 1))
    row = metrics.curve(ledger.ledger(df, K, ledger.FREE), K, 365).first()
    assert row["total_return"] == pytest.approx(0.21) and row["cagr"] == pytest.approx(1.21 ** (365.25 / 2) - 1)


def test_candidates_move_and_never_come_again():
    axes = {"a": [1, 2, 3, 4], "b": [10, 20, 30], "c": ["x"]}
    here = {"a": 1, "b": 20, "c": "x"}
    assert sorted((p["a"], p["b"]) for p in search.around(here, axes)) == [(1, 10), (1, 30), (2, 10), (2, 20), (2, 30)]
    taken, met = set(), []
    for epoch in range(5):
        found = search.candidates(epoch, here, axes, 3, 4, taken)
        assert found == search.candidates(epoch, here, axes, 3, 4, taken) and (found[0] == here)
        new = [search.key(p) for p in found[1:]]
        assert not set(new) & (taken | {search.key(here)}) and len(set(new)) == len(new)
        taken |= set(new)
        met += new
    assert len(met) == 11 and search.candidates(9, here, axes, 3, 4, taken) == [here]  # the grid is exhausted


def test_panel_mean_and_recovery_threshold(spark):
    rows = spark.createDataFrame([("p", "A", 1.0, 1.21, 4), ("p", "B", 3.0, 0.0, 4), ("q", "A", 0.5, 1.0, 4)], "params_json string, symbol string, sharpe double, equity_end double, n int")
    assert strategies.recovery_threshold(5.0, 1.0, 8) == pytest.approx(4 * 6e-4 / 8)
    from barforge.functions import metrics

    found = {r["params_json"]: r for r in metrics.panel_mean(rows, ["params_json"], 2.0).collect()}
    assert found["p"]["mean_sharpe"] == 2.0 and found["p"]["mean_annual"] == pytest.approx((0.1 - 1) / 2) and found["q"]["mean_annual"] == 0.0


def test_preview_and_report(spark, tmp_path):
    import json

    from barforge.operators import kernels
    from barforge.plans import report

    df = helpers.bars(spark, helpers.ou(300, theta=0.2))
    run = strategies.make("mean_reversion", {"window": 8, "atr_len": 4, "k": 1.0, "max_bars": 9}).generate(df, K)
    trades = kernels.bracket_trades(run, K, 2.0, 3.0, 9)
    found = report.preview(run, trades, 50)
    assert len(found["bars"]) == 50 and [b["ts"] for b in found["bars"]] == sorted(b["ts"] for b in found["bars"])
    assert found["trades"] and all(t["exit_ts"] >= found["bars"][0]["ts"] for t in found["trades"])
    book = ledger.ledger(run.withColumn("target", F.when(F.col("target") > 0, F.col("target")).otherwise(0.0)), K)
    document = report.report(book, {"sharpe": float("nan"), "alive": False, "reasons": ["x", float("inf")]}, {"n": {"a": -float("inf")}})
    assert document["run"] == {"sharpe": None, "alive": False, "reasons": ["x", None]} and document["extra"] == {"n": {"a": None}} and len(document["equity"]) == 300
    paths = report.write_report(document, str(tmp_path / "out"))
    assert json.loads(open(paths[0]).read())["ts"] == document["ts"]
