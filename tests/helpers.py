"""Small bar frames and the synthetic processes that tests draw on."""

from datetime import datetime, timedelta

import numpy as np

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades double, taker_buy_volume double"


def bars(spark, closes, symbol="A", step=3600, start=datetime(2024, 1, 1), spread=1.0, skip=(), volume=10.0, quote=1e6):
    rows, before = [], None
    for i, c in enumerate(closes):
        c = float(c)
        o = c if before is None else before
        before = c
        if i not in skip:
            rows.append((symbol, start + timedelta(seconds=step * i), o, max(o, c) + spread, min(o, c) - spread, c, volume, quote, 5.0, 6.0))
    return spark.createDataFrame(rows, BAR)


def ou(n=5000, theta=0.02, mu=100.0, sigma=1.0, seed=42):
    e = np.random.default_rng(seed).standard_normal(n)
    x = np.empty(n)
    x[0] = mu
    for i in range(1, n):
        x[i] = x[i - 1] + theta * (mu - x[i - 1]) + sigma * e[i]
    return x
