"""DuckDB SQL of the catalogue's queries, from shared pieces."""

from __future__ import annotations

HOURLY = """
hourly AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_volume, CAST(count(*) AS DOUBLE) AS trades
  FROM events GROUP BY 1, 2
)"""
TIE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
DAILY = f"""
daily AS (
  SELECT l_returnflag AS symbol, time_bucket(INTERVAL 1 DAY, l_shipdate) AS ts, first(l_extendedprice ORDER BY {TIE}) AS open, max(l_extendedprice) AS high,
    min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {TIE}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice * l_quantity) AS quote_volume,
    CAST(count(*) AS DOUBLE) AS trades
  FROM lineitem GROUP BY 1, 2
)"""
SMOOTH = (
    DAILY
    + """,
smooth AS (
  SELECT symbol, ts, round(quote_volume / volume, 4) AS close, round(round(quote_volume / volume, 4) * 1.05, 4) AS high, round(round(quote_volume / volume, 4) * 0.95, 4) AS low,
    volume, quote_volume FROM daily
)"""
)


def segments(source: str, name: str, seconds: int) -> str:
    return f""",
{name}_g AS (
  SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) > {seconds}, false) AS gap_start FROM {source}
), {name} AS (
  SELECT *, CAST(sum(CAST(gap_start AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INT) AS segment,
    coalesce(lead(gap_start) OVER (PARTITION BY symbol ORDER BY ts), false) AS before_gap FROM {name}_g
)"""


FUNDING = """,
rates AS (SELECT ts, (value - 50) / 1e6 AS rate FROM events WHERE event_type = 'signup'),
funded AS (
  SELECT b.*, coalesce(r.rate, 0.0) AS funding_rate FROM hourly b
  LEFT JOIN (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, sum(rate) AS rate FROM rates GROUP BY 1) r ON r.ts = b.ts
)"""
W20 = "(PARTITION BY symbol, segment ORDER BY ts ROWS 19 PRECEDING)"
#: Targets of a hundredth from z-scores, masked where a bar can't be traded.
TARGET = (
    SMOOTH
    + segments("smooth", "seg", 86400)
    + f""",
zs AS (
  SELECT *, CASE WHEN count(close) OVER w = 20 AND stddev_pop(close) OVER w > 1e-12 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w ELSE 0.0 END AS z
  FROM seg WINDOW w AS {W20}
), targets AS (
  SELECT *, CASE WHEN before_gap OR NOT (volume > 0 AND low > 0) THEN 0.0 WHEN z <= -1 THEN 0.01 WHEN z >= 1 THEN -0.01 ELSE 0.0 END AS target FROM zs
)"""
)


def book(source: str = "targets", capital: float = 1e6, share: float = 0.1) -> str:
    return f""",
b1 AS (
  SELECT *, coalesce(close / lag(close) OVER s - 1, 0.0) AS price_return, lag(target, 1, 0.0) OVER s AS held FROM {source} WINDOW s AS (PARTITION BY symbol ORDER BY ts)
), b2 AS (SELECT *, coalesce(abs(held - lag(held) OVER (PARTITION BY symbol ORDER BY ts)), 0.0) AS turnover FROM b1),
b3 AS (
  SELECT *, held * price_return AS gross_return, turnover * 5.0 * 1e-4 AS fee,
    turnover * (0.5 + 1e4 * 0.1 * least(turnover * {capital} / quote_volume, 1.0)) * 1e-4 AS slippage, turnover * {capital} / quote_volume AS participation,
    turnover * {capital} > {share} * quote_volume AS cap_hit FROM b2
), b4 AS (SELECT *, gross_return - fee - slippage AS returns FROM b3),
b5 AS (SELECT *, product(1 + returns) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM b4),
book AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM b5)"""


BOOK = TARGET + book()
TRADES = (
    BOOK
    + """,
t1 AS (SELECT *, sign(held) AS side, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0.0) AS was FROM book),
t2 AS (SELECT *, CAST(side <> 0 AND side <> sign(was) AS INT) AS starts FROM t1),
t3 AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id,
  CASE WHEN was = 0 OR sign(was) = side THEN 0.0 WHEN side = 0 THEN 1.0 ELSE abs(was) / (abs(was) + abs(held)) END AS closing FROM t2),
trades AS (
  SELECT symbol, trade_id, sum(amount) AS trade_return FROM (
    SELECT symbol, id AS trade_id, gross_return - (1 - closing) * (fee + slippage) AS amount FROM t3 WHERE side <> 0
    UNION ALL SELECT symbol, id - starts, -closing * (fee + slippage) FROM t3 WHERE was <> 0 AND sign(was) <> side) GROUP BY ALL
)"""
)
RUNS = """
runs AS (
  SELECT 'c' || o_orderkey AS config_id, o_orderpriority AS symbol, o_orderstatus AS timeframe, o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 301 END AS trades,
    (o_orderkey % 1009) / 1000.0::DOUBLE AS dsr, (o_orderkey % 97) / 970.0::DOUBLE AS p_value, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 89) / 100.0::DOUBLE END AS pbo,
    o_totalprice / 1e5 - 1 AS sharpe, o_orderkey % 11 = 0 AS failed, o_orderkey % 13 = 0 AS screening, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 AS alive,
    o_orderkey % 17 <> 0 AS known, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 THEN 50 ELSE 100 END AS t1,
    CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS t2, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS t3,
    CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS t4
  FROM orders
), gated AS (
  SELECT *, trades >= t1 AS g1, trades >= t1 AND dsr > t2 AS g2, trades >= t1 AND dsr > t2 AND p_value < t3 AS g3, trades >= t1 AND dsr > t2 AND p_value < t3 AND coalesce(pbo < t4, false) AS g4 FROM runs
)"""
R = lambda c, n=6, name=None: f"round({c}, {n}) + 0.0 AS {name or c}"
LONG = lambda c, name: f"CAST({c} AS BIGINT) AS {name}"


def wilder(source: str, value: str, name: str, length: int = 14) -> str:
    """Recursive smoothing of ``value`` over the rows (symbol, segment, n) of ``source``, numbered from 1 within segments, without holes from row ``first``."""
    return f""",
{name}_seed AS (
  SELECT symbol, segment, min(n) + {length - 1} AS n0, avg({value}) FILTER (n < lo + {length}) AS v
  FROM (SELECT *, min(n) FILTER ({value} IS NOT NULL) OVER (PARTITION BY symbol, segment) AS lo FROM {source}) WHERE {value} IS NOT NULL GROUP BY symbol, segment HAVING count(*) >= {length}
), {name} AS (
  SELECT symbol, segment, n0 AS n, v FROM {name}_seed
  UNION ALL SELECT a.symbol, a.segment, a.n + 1, a.v + (s.{value} - a.v) / {length} FROM {name} a JOIN {source} s ON s.symbol = a.symbol AND s.segment = a.segment AND s.n = a.n + 1
)"""


RANGES = (
    DAILY
    + segments("daily", "seg", 86400)
    + """,
tr AS (
  SELECT *, row_number() OVER w AS n, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0.0), coalesce(abs(low - lag(close) OVER w), 0.0)) AS tr,
    high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts)
), dm AS (
  SELECT *, CASE WHEN up IS NULL THEN NULL WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN up IS NULL THEN NULL WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS mdm FROM tr
)"""
)

def reversion(allowed: str = "true") -> str:
    """walk: mean reversion at 1.5 deviations with stops of 2, takes of 3 average ranges and 20 bars at most, each bar with its position ``pos`` and the bar of entry ``since``."""
    return f"""{SMOOTH + segments('smooth', 'seg', 86400)}, tr AS MATERIALIZED (
      SELECT *, row_number() OVER w AS n, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0.0), coalesce(abs(low - lag(close) OVER w), 0.0)) AS tr
      FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts)){wilder('tr', 'tr', 'a')}, sg AS (
      SELECT *, CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w END AS sigma, avg(close) OVER w AS mean FROM tr WINDOW w AS {W20}), sq AS (
      SELECT *, coalesce(count(sigma) OVER w = 30 AND sigma < avg(sigma) OVER w * 1.2, false) AS squeezed FROM sg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts ROWS 29 PRECEDING)), en AS MATERIALIZED (
      SELECT sq.*, a.v AS atr, CAST(CASE WHEN sq.n < 20 OR a.v IS NULL OR NOT {allowed} OR coalesce(sigma, 0) <= 1e-12 THEN 0 WHEN (close - mean) / sigma >= 1.5 THEN -1 WHEN (close - mean) / sigma <= -1.5 THEN 1 ELSE 0 END AS DOUBLE) AS side
      FROM sq LEFT JOIN a ON a.symbol = sq.symbol AND a.segment = sq.segment AND a.n = sq.n), st AS (
      SELECT symbol, segment, 0::BIGINT AS n, 0.0::DOUBLE AS pos, 0::BIGINT AS since, 0.0::DOUBLE AS sl, 0.0::DOUBLE AS tp FROM (SELECT DISTINCT symbol, segment FROM seg)
      UNION ALL
      SELECT symbol, segment, n, CASE WHEN d > 0 AND (low <= sl OR high >= tp OR n - since >= 20) THEN 0.0 WHEN d < 0 AND (high >= sl OR low <= tp OR n - since >= 20) THEN 0.0 ELSE d END, since, sl, tp FROM (
        SELECT en.symbol, en.segment, en.n, en.high, en.low, CASE WHEN st.pos <> 0 THEN st.pos ELSE en.side END AS d, CASE WHEN st.pos <> 0 THEN st.since ELSE en.n END AS since,
          CASE WHEN st.pos <> 0 THEN st.sl ELSE coalesce(en.close - en.side * en.atr * 2.0, 0.0) END AS sl, CASE WHEN st.pos <> 0 THEN st.tp ELSE coalesce(en.close + en.side * en.atr * 3.0, 0.0) END AS tp
        FROM st JOIN en ON en.symbol = st.symbol AND en.segment = st.segment AND en.n = st.n + 1)), walk AS (
      SELECT en.*, st.pos, st.since FROM st JOIN en ON en.symbol = st.symbol AND en.segment = st.segment AND en.n = st.n)"""


def book_totals(digits: int = 6) -> str:
    """Cost totals, capacity and the end of the curve of each symbol's book."""
    return f"""SELECT symbol, count(*) AS bars, {R('sum(fee)', digits, 'fee')}, {R('sum(slippage)', digits, 'slippage')}, 0.0::DOUBLE AS funding, {R('sum(turnover)', digits, 'turnover')},
      count(*) FILTER (cap_hit) AS cap_hits, {R('max(participation)', digits, 'max_participation_observed')}, count(*) FILTER (cap_hit) > 0 AS over_capacity,
      {R('last(equity ORDER BY ts)', digits, 'equity_end')}, {R('min(drawdown)', digits, 'max_drawdown')} FROM book GROUP BY symbol"""


#: Returns of eight lagged rules on each symbol, long: x (symbol, ts, c, v).
MATRIX = f"""p AS (
      SELECT symbol, ts, coalesce(close / lag(close) OVER w - 1, 0.0) AS r, {', '.join(f"coalesce(sign(lag(close, 1) OVER w - lag(close, {k}) OVER w), 0) AS s{k}" for k in range(2, 10))} FROM smooth WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      x AS (SELECT symbol, ts, u.c, u.v FROM (SELECT symbol, ts, unnest([{', '.join(f"{{'c': 'k{k}', 'v': round(r * s{k}, 6)}}" for k in range(2, 10))}]) AS u FROM p))"""
SQL: dict[str, str] = {
    "resample_hourly": f"WITH {HOURLY} SELECT symbol, ts, {', '.join(R(c, 4) for c in ('open', 'high', 'low', 'close', 'volume', 'quote_volume', 'trades'))} FROM hourly",
    "resample_daily": f"WITH {DAILY} SELECT symbol, ts, {', '.join(R(c, 2) for c in ('open', 'high', 'low', 'close', 'volume', 'quote_volume', 'trades'))} FROM daily",
    "resample_bars_4h": f"""WITH {HOURLY} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, {R('first(open ORDER BY ts)', 4, 'open')}, {R('max(high)', 4, 'high')}, {R('min(low)', 4, 'low')},
      {R('last(close ORDER BY ts)', 4, 'close')}, {R('sum(volume)', 4, 'volume')}, {R('sum(quote_volume)', 4, 'quote_volume')}, {R('sum(trades)', 4, 'trades')} FROM hourly h GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts)""",
    "scan_range_pushdown": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' GROUP BY 1",
    "dedup_keep_last": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""",
    "quality_report": f"""WITH {HOURLY + segments('hourly', 'seg', 3600)}, q AS (
      SELECT *, NOT (trades > 1) AS nov, low <= 0 OR high < low AS odd FROM seg)
      SELECT symbol, count(*) AS total, count(*) FILTER (gap_start) AS gaps, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (nov) AS zero_volume,
        count(*) FILTER (odd) AS anomalous, count(*) FILTER (nov) + count(*) FILTER (odd) AS bad_rows FROM q GROUP BY symbol""",
    "gap_statistics": f"""WITH {HOURLY}, w AS (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS s FROM hourly)
      SELECT symbol, count(*) FILTER (s > 3600) AS gaps, CAST(round(coalesce(sum(s - 3600) FILTER (s > 3600), 0) / 3600) AS BIGINT) AS missing_bars FROM w GROUP BY symbol""",
    "gap_segments": f"WITH {HOURLY + segments('hourly', 'seg', 3600)} SELECT symbol, ts, gap_start, segment, NOT before_gap AND volume > 0 AND low > 0 AS tradable FROM seg",
    "rolling_features": f"""WITH {RANGES}, f AS (
      SELECT symbol, ts, tr, pdm, mdm, CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w END AS sigma, avg(close) OVER w AS m, close FROM dm WINDOW w AS {W20})
      SELECT symbol, ts, {R('sigma', 4)}, round(CASE WHEN sigma > 1e-12 THEN (close - m) / sigma ELSE 0.0 END, 4) + 0.0 AS z, {R('tr', 4)}, {R('pdm', 4, 'plus_dm')}, {R('mdm', 4, 'minus_dm')},
        CASE WHEN sigma > 1e-12 THEN CASE WHEN (close - m) / sigma <= -1 THEN -1 WHEN (close - m) / sigma >= 1 THEN 1 ELSE 0 END END AS regime FROM f""",
    "rolling_quantiles": f"""WITH {DAILY + segments('daily', 'seg', 86400)} SELECT symbol, ts,
      {', '.join(f"CASE WHEN count(close) OVER w = 50 THEN round(quantile_cont(close, {q}) OVER w, 4) END AS q{int(q * 100)}" for q in (0.05, 0.95))}
      FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts ROWS 49 PRECEDING)""",
    "ou_regression": f"""WITH {SMOOTH}, p AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM smooth),
      f AS (SELECT symbol, count(close) AS n, count(x) AS m, avg(x) AS mx, avg(close - x) FILTER (x IS NOT NULL) AS my, regr_sxx(close - x, x) AS sxx, regr_sxy(close - x, x) AS sxy, regr_syy(close - x, x) AS syy FROM p GROUP BY 1),
      g AS (SELECT *, sxy / sxx AS b, my - sxy / sxx * mx AS a FROM f)
      SELECT symbol, n, {R('-b', 5, 'theta')}, {R('-a / b', 5, 'mu')}, {R('sqrt((syy - b * sxy) / (m - 2))', 5, 'sigma')}, {R('ln(2) / -b', 5, 'half_life')}, {R('1 - (syy - b * sxy) / syy', 5, 'r2')} FROM g""",
    "half_life_filter": f"""WITH {SMOOTH + segments('smooth', 'seg', 86400)}, p AS (
      SELECT symbol, segment, ts, row_number() OVER w AS n, lag(close) OVER w AS x, close - lag(close) OVER w AS y FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts)),
      f AS (SELECT *, regr_slope(y, x) OVER w AS b, count(y) OVER w AS k FROM p WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING))
      SELECT symbol, ts, coalesce(n > 50 AND k = 49 AND b < 0 AND ln(2) / -b BETWEEN 0.6 AND 0.75, false) AS hl_ok FROM f""",
    "squeeze_filter": f"""WITH {SMOOTH + segments('smooth', 'seg', 86400)}, s AS (
      SELECT symbol, segment, ts, CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w END AS sigma FROM seg WINDOW w AS {W20})
      SELECT symbol, ts, coalesce(count(sigma) OVER w = 30 AND sigma < avg(sigma) OVER w * 0.8, false) AS squeezed FROM s WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts ROWS 29 PRECEDING)""",
    "wilder_atr": f"WITH RECURSIVE {RANGES + wilder('dm', 'tr', 'a')} SELECT t.symbol, t.ts, {R('a.v', 3, 'atr')} FROM dm t LEFT JOIN a ON a.symbol = t.symbol AND a.segment = t.segment AND a.n = t.n",
    "adx": f"""WITH RECURSIVE {RANGES + wilder('dm', 'tr', 'a') + wilder('dm', 'pdm', 'p') + wilder('dm', 'mdm', 'm')}, di AS (
      SELECT symbol, segment, n, ts, CASE WHEN a.v > 0 THEN 100 * p.v / a.v END AS dip, CASE WHEN a.v > 0 THEN 100 * m.v / a.v END AS dim
      FROM dm LEFT JOIN a USING (symbol, segment, n) LEFT JOIN p USING (symbol, segment, n) LEFT JOIN m USING (symbol, segment, n)),
      dx AS (SELECT *, 100 * abs(dip - dim) / CASE WHEN dip + dim = 0 THEN 1 ELSE dip + dim END AS dx FROM di){wilder('dx', 'dx', 'x')}
      SELECT symbol, ts, {R('x.v', 4, 'adx')} FROM dx LEFT JOIN x USING (symbol, segment, n)""",
    "funding_join": f"WITH {HOURLY + FUNDING} SELECT symbol, ts, {R('funding_rate', 10, 'general')}, {R('funding_rate', 10)} FROM funded",
    "funding_join_median": f"""WITH {HOURLY + FUNDING}, b AS (
      SELECT symbol, ts, lead(ts) OVER w AS following, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM hourly
      WHERE hour(ts) % CASE symbol WHEN 'click' THEN 4 WHEN 'view' THEN 24 ELSE 1 END = 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      m AS (SELECT symbol, coalesce(median(gap) FILTER (gap > 0), 1e-6) AS step FROM b GROUP BY 1)
      SELECT b.symbol, b.ts, {R('coalesce(sum(r.rate), 0.0)', 10, 'funding_rate')} FROM b JOIN m USING (symbol)
      LEFT JOIN rates r ON r.ts >= b.ts AND epoch(r.ts) < epoch(b.ts) + m.step AND (b.following IS NULL OR r.ts < b.following) GROUP BY b.symbol, b.ts""",
    "funding_matched": f"WITH {HOURLY + FUNDING} SELECT b.symbol, count(r.ts) AS matched FROM hourly b LEFT JOIN rates r ON r.ts >= b.ts AND r.ts < b.ts + INTERVAL 1 HOUR GROUP BY 1",
    "funding_features": f"""WITH {HOURLY + FUNDING}, f AS (SELECT symbol, ts, round(funding_rate * 1e6, 3) AS x FROM funded)
      SELECT symbol, ts, round(avg(x) OVER (PARTITION BY symbol ORDER BY ts ROWS 7 PRECEDING), 5) + 0.0 AS ma,
        round(CASE WHEN count(x) OVER w = 24 AND stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0.0 END, 5) + 0.0 AS z
      FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""",
    "threshold_targets": f"WITH {TARGET} SELECT symbol, ts, target FROM targets",
    "bracket_exits": f"""WITH RECURSIVE {SMOOTH}, e AS (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM smooth), s AS (
      SELECT *, CASE WHEN n % 11 = 0 THEN 1.0 WHEN n % 7 = 0 THEN -1.0 ELSE 0.0 END AS side FROM e), st AS (
      SELECT symbol, 0::BIGINT AS n, 0.0::DOUBLE AS pos, 0::BIGINT AS since, 0.0::DOUBLE AS sl, 0.0::DOUBLE AS tp FROM (SELECT DISTINCT symbol FROM smooth)
      UNION ALL
      SELECT symbol, n, CASE WHEN d > 0 AND (low <= sl OR high >= tp OR n - since >= 5) THEN 0.0 WHEN d < 0 AND (high >= sl OR low <= tp OR n - since >= 5) THEN 0.0 ELSE d END, since, sl, tp FROM (
        SELECT s.symbol, s.n, s.high, s.low, CASE WHEN st.pos <> 0 THEN st.pos ELSE CAST(s.side AS DOUBLE) END AS d, CASE WHEN st.pos <> 0 THEN st.since ELSE s.n END AS since,
          CASE WHEN st.pos <> 0 THEN st.sl ELSE CAST(s.close * (1 - 0.08 * s.side) AS DOUBLE) END AS sl, CASE WHEN st.pos <> 0 THEN st.tp ELSE CAST(s.close * (1 + 0.1 * s.side) AS DOUBLE) END AS tp
        FROM st JOIN s ON s.symbol = st.symbol AND s.n = st.n + 1))
      SELECT s.symbol, s.ts, st.pos + 0.0 AS target FROM st JOIN s ON s.symbol = st.symbol AND s.n = st.n""",
    "ledger_bars": f"WITH {BOOK} SELECT symbol, ts, {', '.join(R(c, 7) for c in ('held', 'price_return', 'turnover', 'gross_return', 'fee', 'slippage', 'returns', 'drawdown'))}, {R('equity', 5)} FROM book",
    "ledger_totals": f"WITH {BOOK} {book_totals()}",
    "mean_reversion_run": f"""WITH RECURSIVE {reversion('squeezed')}, targets AS (
      SELECT *, CASE WHEN before_gap OR NOT (volume > 0 AND low > 0) THEN 0.0 ELSE pos * 0.01 END AS target FROM walk){book(capital=1e4, share=0.01)} {book_totals()}""",
    "bracket_trade_list": f"""WITH RECURSIVE {reversion()}, o AS (
      SELECT *, lag(pos, 1, 0.0) OVER w AS was, lead(n) OVER w IS NULL AS final FROM walk WINDOW w AS (PARTITION BY symbol, segment ORDER BY n)), x AS (
      SELECT symbol, segment, n, ts, since, pos <> 0 AS still, high, low, close FROM o WHERE (pos = 0 AND was <> 0) OR (pos <> 0 AND final)), t AS (
      SELECT x.symbol, x.segment, e.ts AS entry_ts, x.ts AS exit_ts, e.side, x.n - e.n AS bars, x.still, x.high, x.low, x.close AS leaving, e.close AS entered, 2.0 * e.atr AS risk,
        e.close - e.side * e.atr * 2.0 AS sl, e.close + e.side * e.atr * 3.0 AS tp FROM x JOIN en e ON e.symbol = x.symbol AND e.segment = x.segment AND e.n = x.since), r AS (
      SELECT *, CASE WHEN still THEN 'open' WHEN (side > 0 AND low <= sl) OR (side < 0 AND high >= sl) THEN 'stop' WHEN bars >= 20 THEN 'time'
        WHEN (side > 0 AND high >= tp) OR (side < 0 AND low <= tp) THEN 'take' ELSE 'signal' END AS reason FROM t)
      SELECT symbol, segment, entry_ts, exit_ts, CAST(side AS INT) AS side, {LONG('bars', 'bars')}, reason, {R("side * (CASE reason WHEN 'stop' THEN sl WHEN 'take' THEN tp ELSE leaving END - entered) / CASE WHEN risk > 0 THEN risk END", 6, 'r')} FROM r""",
    "trade_returns": f"WITH {TRADES} SELECT symbol, {LONG('trade_id', 'trade_id')}, {R('trade_return', 7)} FROM trades",
    "position_episodes": f"""WITH {BOOK}, e1 AS (SELECT *, held <> 0 AS active, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0.0) <> 0 AS was FROM book),
      e2 AS (SELECT *, sum(CAST(active AND NOT was AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM e1)
      SELECT symbol, {LONG('episode', 'episode')}, min(ts) AS start, max(ts) AS "end", count(*) AS bars, {R('sum(gross_return)', 7, 'price_pnl')}, 0.0::DOUBLE AS funding_income, {R('sum(fee)', 7, 'fee')},
        {R('sum(slippage)', 7, 'slippage')}, {R('sum(returns)', 7, 'net_return')} FROM e2 WHERE active OR was GROUP BY symbol, episode""",
    "run_summary": f"""WITH {TRADES}, a AS (
      SELECT symbol, avg(returns) AS m, stddev_samp(returns) AS sd, stddev_samp(returns) FILTER (returns < 0) AS dd, min(drawdown) AS mdd, last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1 AS total_return FROM book GROUP BY 1),
      t AS (SELECT symbol, count(*) AS trades, avg(CAST(trade_return > 0 AS DOUBLE)) AS win_rate, avg(trade_return) AS avg_trade, sum(trade_return) FILTER (trade_return > 0) / abs(sum(trade_return) FILTER (trade_return < 0)) AS profit_factor FROM trades GROUP BY 1)
      SELECT symbol, {R('CASE WHEN sd < 1e-12 THEN 0.0 ELSE m / sd * sqrt(365.0) END', 5, 'sharpe')}, {R('CASE WHEN coalesce(dd, 0) < 1e-12 THEN 0.0 ELSE m / dd * sqrt(365.0) END', 5, 'sortino')},
        {R('CASE WHEN abs(mdd) < 1e-12 THEN 0.0 ELSE m * 365.0 / abs(mdd) END', 5, 'calmar')}, {R('mdd', 5, 'max_drawdown')}, {R('total_return', 5)},
        coalesce(trades, 0) AS trades, {R('coalesce(win_rate, 0)', 5, 'win_rate')}, {R('coalesce(avg_trade, 0)', 5, 'avg_trade')}, {R('profit_factor', 5)} FROM a LEFT JOIN t USING (symbol)""",
    "curve_metrics": f"""WITH {BOOK}, c AS (SELECT symbol, last(equity ORDER BY ts) - 1 AS total_return, (epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400) AS y, stddev_samp(returns) AS sd, avg(returns) AS m, min(drawdown) AS mdd FROM book GROUP BY 1)
      SELECT symbol, {R('total_return', 5)}, {R('sd * sqrt(365.0)', 5, 'volatility')}, {R('mdd', 5, 'max_drawdown')}, {R('CASE WHEN sd < 1e-12 THEN 0.0 ELSE m / sd * sqrt(365.0) END', 5, 'sharpe')}, {R('pow(1 + total_return, 1 / y) - 1', 5, 'cagr')} FROM c""",
    "position_shares": f"WITH {BOOK} SELECT symbol, {R('avg(CAST(held > 0 AS DOUBLE))', 6, 'long_share')}, {R('avg(CAST(held < 0 AS DOUBLE))', 6, 'short_share')} FROM book GROUP BY 1",
    "entry_exit_counts": f"""WITH {BOOK}, e AS (SELECT *, held <> 0 AS on_, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0.0) <> 0 AS was FROM book)
      SELECT symbol, count(*) FILTER (on_ AND NOT was) AS entries, count(*) FILTER (was AND NOT on_) AS exits, count(*) AS bars FROM e WHERE ts <= TIMESTAMP '1998-12-31' GROUP BY 1""",
    "return_moments": f"""WITH {BOOK}, c AS (SELECT symbol, returns, avg(returns) OVER (PARTITION BY symbol) AS m FROM book),
      k AS (SELECT symbol, count(*) AS n, avg(returns) AS mean, stddev_samp(returns) AS sd, avg(pow(returns - m, 2)) AS m2, avg(pow(returns - m, 3)) AS m3, avg(pow(returns - m, 4)) AS m4 FROM c GROUP BY 1)
      SELECT symbol, n, {R('mean', 5)}, {R('sd', 5)}, {R('m3 / nullif(pow(m2, 1.5), 0)', 5, 'skew')}, {R('m4 / nullif(m2 * m2, 0)', 5, 'kurt')} FROM k""",
    "harvest_book": f"""WITH {HOURLY + FUNDING + segments('funded', 'seg', 3600)}, h AS (
      SELECT *, coalesce(count(*) OVER w = 8 AND avg(funding_rate) OVER w > 0, false) AS on_ FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts ROWS 7 PRECEDING)),
      g AS (SELECT *, lag(CASE WHEN on_ THEN 1.0::DOUBLE ELSE 0.0 END, 1, 0.0) OVER (PARTITION BY symbol ORDER BY ts) AS gross FROM h),
      t AS (SELECT *, coalesce(abs(gross - lag(gross) OVER (PARTITION BY symbol ORDER BY ts)), 0.0) AS turnover FROM g),
      c AS (SELECT *, turnover * 5e-4 AS fee, turnover * (0.5 + 1000 * least(turnover * 10.0 / quote_volume, 1.0)) * 1e-4 AS slippage, -gross / 2 * funding_rate AS funding, turnover * 10.0 / quote_volume AS part FROM t),
      q AS (SELECT *, product(1 - fee - slippage - funding) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM c),
      d AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM q)
      SELECT symbol, count(*) AS bars, {R('sum(fee)', 7, 'fee')}, {R('sum(slippage)', 7, 'slippage')}, {R('sum(funding)', 7, 'funding')}, {R('sum(turnover)', 7, 'turnover')}, count(*) FILTER (turnover * 10.0 > 0.1 * quote_volume) AS cap_hits,
        {R('max(part)', 7, 'max_participation_observed')}, count(*) FILTER (turnover * 10.0 > 0.1 * quote_volume) > 0 AS over_capacity, {R('last(equity ORDER BY ts)', 7, 'equity_end')}, {R('min(drawdown)', 7, 'max_drawdown')},
        sum(turnover) > 0 AS delta_neutral FROM d GROUP BY symbol""",
    "portfolio_mean": f"""WITH {BOOK}, m AS (
      SELECT ts, CASE WHEN count(*) = (SELECT count(DISTINCT symbol) FROM book) THEN avg(returns) END AS returns, count(*) FILTER (held <> 0) AS in_book, count(*) FILTER (cap_hit) AS cap_hits FROM book GROUP BY ts)
      SELECT ts, {R('returns', 7)}, in_book, cap_hits, CASE WHEN returns IS NOT NULL THEN round(product(1 + returns) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 5) + 0.0 END AS equity FROM m""",
    "matrix_faults": f"""WITH {SMOOTH}, {MATRIX},
      m AS (SELECT * FROM x UNION ALL SELECT symbol, ts, 'copy', v FROM x WHERE c = 'k2' UNION ALL SELECT symbol, ts, 'short', v FROM x WHERE c = 'k3' AND ts < TIMESTAMP '1998-01-01'
        UNION ALL SELECT symbol, ts, 'holes', CASE WHEN ts > TIMESTAMP '1998-01-01' THEN NULL ELSE v END FROM x WHERE c = 'k4'),
      e AS (SELECT symbol, c, list(ts ORDER BY ts) AS times, list(v ORDER BY ts) AS content, count(*) FILTER (v IS NULL) AS bad FROM m GROUP BY 1, 2),
      u AS (SELECT symbol, arg_max(times, k) AS usual FROM (SELECT symbol, times, count(*) AS k FROM e GROUP BY 1, 2) GROUP BY 1)
      SELECT symbol, 'other times' AS fault, c AS config_id FROM e JOIN u USING (symbol) WHERE times <> usual
      UNION ALL SELECT symbol, 'value not finite', c FROM e WHERE bad > 0
      UNION ALL SELECT symbol, 'equal to another', c FROM (SELECT *, count(*) OVER (PARTITION BY symbol, times, content) AS k FROM e) WHERE k > 1""",
    "hurst_exponent": f"""WITH {SMOOTH}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM smooth),
      d AS (SELECT a.symbol, k, stddev_pop(b.close - a.close) AS sd FROM n a CROSS JOIN range(2, 100) t(k) JOIN n b ON a.symbol = b.symbol AND b.i = a.i + k WHERE a.n >= 400 GROUP BY 1, 2),
      h AS (SELECT symbol, CASE WHEN count(*) >= 4 THEN regr_slope(ln(sd), ln(k)) END AS h FROM d WHERE sd > 1e-12 GROUP BY 1)
      SELECT symbol, {R('h', 6, 'hurst')} FROM (SELECT DISTINCT symbol FROM n) LEFT JOIN h USING (symbol)""",
    "causality_honest": "SELECT CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS INT) AS cut, CAST(NULL AS TIMESTAMP) AS first_ts, CAST(NULL AS INT) AS n_cuts WHERE false",
    "causality_leaks": f"""WITH {SMOOTH}, n AS (SELECT symbol, ts, close, row_number() OVER w AS i, lead(close) OVER w AS following, count(*) OVER (PARTITION BY symbol) AS n FROM smooth WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      c AS (SELECT symbol, list_distinct(CASE WHEN n <= 600 THEN range(2, n) ELSE list_concat(range(2, n, n // 200), [n // 4, n // 2, 3 * n // 4, n - 1]) END) AS cuts FROM (SELECT DISTINCT symbol, n FROM n))
      SELECT symbol, CAST(i AS INT) AS cut, ts AS first_ts, CAST(len(cuts) AS INT) AS n_cuts FROM n JOIN c USING (symbol) WHERE list_contains(cuts, i) AND following <> close""",
    "overfitting_probability": f"""WITH {SMOOTH}, {MATRIX},
      n AS (SELECT *, row_number() OVER (PARTITION BY symbol, c ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, c) // 6 AS size FROM x),
      b AS (SELECT symbol, c, i // size AS blk, v FROM n WHERE i < 6 * size),
      k AS (SELECT m FROM range(0, 64) t(m) WHERE bit_count(m::INT) = 3),
      s AS (SELECT symbol, m, c, avg(v) FILTER ((m >> blk) & 1 = 1) / stddev_samp(v) FILTER ((m >> blk) & 1 = 1) AS a, avg(v) FILTER ((m >> blk) & 1 = 0) / stddev_samp(v) FILTER ((m >> blk) & 1 = 0) AS z FROM b, k GROUP BY symbol, m, c),
      r AS (SELECT *, row_number() OVER (PARTITION BY symbol, m ORDER BY a DESC, c) AS place, rank() OVER (PARTITION BY symbol, m ORDER BY z) + (count(*) OVER (PARTITION BY symbol, m, z) - 1) / 2 AS rk FROM s)
      SELECT symbol, {R('avg(CAST(rk / 9.0 < 0.5 AS DOUBLE))', 6, 'pbo')} FROM r WHERE place = 1 GROUP BY symbol""",
    "purged_folds": f"""WITH {SMOOTH}, n AS (SELECT symbol, ts, row_number() OVER w - 1 AS i, ntile(5) OVER w - 1 AS own FROM smooth WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
      b AS (SELECT symbol, own AS fold, min(i) AS lo, max(i) AS hi FROM n GROUP BY 1, 2),
      j AS (SELECT n.symbol, n.ts, b.fold, CASE WHEN n.own = b.fold THEN 'test' WHEN n.i < b.lo - 10 OR n.i > b.hi + 20 THEN 'train' END AS role FROM n JOIN b USING (symbol))
      SELECT symbol, CAST(fold AS INT) AS fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM j WHERE role IS NOT NULL GROUP BY ALL""",
    "funnel_counts": f"""WITH {RUNS} SELECT count(*) AS n, {', '.join(f'count(*) FILTER (g{i}) AS n_{g}' for i, g in enumerate(('trades', 'dsr', 'p_value', 'pbo'), 1))}, count(*) FILTER (g4 AND alive) AS n_alive,
      count(*) FILTER (alive AND NOT g4) AS alive_without_pbo, count(*) FILTER (NOT known) AS thresholds_unknown FROM gated WHERE NOT failed AND NOT screening""",
    "funnel_breakdown": f"""WITH {RUNS} SELECT symbol, count(*) FILTER (NOT failed AND NOT screening) AS n, {', '.join(f'count(*) FILTER (NOT failed AND NOT screening AND g{i}) AS n_{g}' for i, g in enumerate(('trades', 'dsr', 'p_value', 'pbo'), 1))},
      count(*) FILTER (NOT failed AND NOT screening AND g4 AND alive) AS n_alive, count(*) FILTER (NOT failed AND screening) AS n_screening, count(*) FILTER (failed) AS n_errors FROM gated GROUP BY symbol""",
    "funnel_reasons": "SELECT reason, count(*) AS n FROM (SELECT unnest(CASE o_orderkey % 3 WHEN 0 THEN ['too few trades', 'DSR low'] WHEN 1 THEN ['DSR low'] ELSE [] END) AS reason FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 1",
    "top_survivors": f"WITH {RUNS} SELECT config_id, symbol, {R('sharpe')} FROM (SELECT *, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, k) AS r FROM gated WHERE NOT failed AND NOT screening AND g4 AND alive) WHERE r <= 10",
    "run_group_counts": f"WITH {RUNS} SELECT timeframe, count(*) AS n FROM runs WHERE NOT failed GROUP BY 1",
    "query_runs": f"WITH {RUNS} SELECT config_id, {R('dsr')}, trades FROM (SELECT *, row_number() OVER (ORDER BY dsr DESC NULLS LAST, k) AS r FROM runs WHERE NOT failed AND symbol = '1-URGENT') WHERE r <= 20",
    "pending_cells": "SELECT 'c' || o_orderkey AS config_id, o_orderdate FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0",
    "results_upsert": f"""WITH {RUNS} SELECT symbol, count(*) AS n, CAST(sum(trades + CASE WHEN k % 4 = 0 THEN 1000 ELSE 0 END) AS BIGINT) AS trades, max(k + CASE WHEN k % 4 = 0 THEN 10000000 ELSE 0 END) AS last_seq FROM runs GROUP BY 1""",
    "symbol_coverage": """WITH b AS (SELECT o_orderpriority AS symbol, count(DISTINCT strftime(o_orderdate, '%Y-%m')) FILTER (year(o_orderdate) BETWEEN 1992 AND 1998) AS n FROM orders GROUP BY 1),
      f AS (SELECT o_orderpriority AS symbol, count(DISTINCT strftime(l_shipdate, '%Y-%m')) FILTER (year(l_shipdate) BETWEEN 1992 AND 1998) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 49 GROUP BY 1)
      SELECT symbol, 84 - b.n AS missing_bar_months, 84 - coalesce(f.n, 0) AS missing_funding_months, b.n = 84 AND coalesce(f.n, 0) = 84 AS complete FROM b LEFT JOIN f USING (symbol)""",
    "funnel_thresholds": f"""WITH {RUNS} SELECT timeframe, {', '.join(f'CASE WHEN min(t{i}) = max(t{i}) THEN CAST(min(t{i}) AS DOUBLE) END AS {k}' for i, k in enumerate(('min_trades', 'min_dsr', 'max_p_value', 'max_pbo'), 1))},
      {' OR '.join(f'min(t{i}) <> max(t{i})' for i in (1, 2, 3, 4))} AS mixed FROM runs WHERE NOT failed GROUP BY 1""",
    "symbols_complete": """SELECT o_orderpriority AS symbol, count(DISTINCT strftime(o_orderdate, '%Y-%m')) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS months,
      count(DISTINCT strftime(o_orderdate, '%Y-%m')) FILTER (o_orderdate < TIMESTAMP '2001-01-01') = 72 AS complete FROM orders GROUP BY 1""",
}
#: Queries over cut series say the same as those over whole ones.
LONG = "gap_segments rolling_features half_life_filter squeeze_filter wilder_atr adx bracket_exits ledger_bars trade_returns position_episodes mean_reversion_run"
SQL |= {f"{name}_long": SQL[name] for name in LONG.split()}
SQL["rolling_quantiles_long"] = f"""WITH {DAILY + segments('daily', 'seg', 86400)} SELECT symbol, ts,
  {', '.join(f"CASE WHEN count(close) OVER w = 400 THEN round(quantile_cont(close, {q}) OVER w, 4) END AS q{int(q * 100)}" for q in (0.05, 0.5, 0.95))}
  FROM seg WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts ROWS 399 PRECEDING)"""
#: Least squares on a level, one step before and a constant, by taking the step out of both sides.
SQL["unit_root_one_lag"] = f"""WITH {SMOOTH}, s AS (SELECT symbol, ts, close, close - lag(close) OVER w AS d, lag(close) OVER w AS x FROM smooth WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  r AS (SELECT symbol, d AS y, x, lag(d) OVER (PARTITION BY symbol ORDER BY ts) AS z FROM s),
  c AS (SELECT symbol, count(*) AS n, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, regr_sxy(z, x) AS xz FROM r WHERE z IS NOT NULL GROUP BY symbol),
  p AS (SELECT symbol, n, xx - xz * xz / zz AS xx, xy - xz * zy / zz AS xy, yy - zy * zy / zz AS yy FROM c)
  SELECT symbol, n + 2 AS n, 1::INT AS lags, {R('xy / xx / sqrt((yy - xy * xy / xx) / (n - 3) / xx)', 5, 'tau')} FROM p"""


def normal(z: str) -> str:
    """The normal distribution at ``z`` by Simpson's rule from 0."""
    return f"""(0.5 + ({z}) / 1200.0 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401),
      lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((({z}) * i / 400.0) ** 2) / 2))))"""


#: Where the normal distribution reaches 1 - 1 / 10 and 1 - 1 / (10 e), by halving; then each book's Sharpe ratio against the best expected of ten trials.
SQL["deflated_sharpe"] = f"""WITH RECURSIVE q AS (SELECT unnest([0.9::DOUBLE, 1 - 1 / (10 * exp(1))]) AS p, 0 AS k, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi
    UNION ALL SELECT p, k + 1, CASE WHEN {normal('((lo + hi) / 2)')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {normal('((lo + hi) / 2)')} < p THEN hi ELSE (lo + hi) / 2 END FROM q WHERE k < 60),
  best AS (SELECT (1 - 0.5772156649015329) * min(lo) + 0.5772156649015329 * max(lo) AS best FROM q WHERE k = 60), {BOOK.removeprefix('WITH ')},
  c AS (SELECT symbol, returns, avg(returns) OVER (PARTITION BY symbol) AS m FROM book),
  k AS (SELECT symbol, count(*) AS n, stddev_samp(returns) AS sd, avg(returns) / stddev_samp(returns) AS sr, avg(pow(returns - m, 3)) / pow(avg(pow(returns - m, 2)), 1.5) AS skew,
    avg(pow(returns - m, 4)) / pow(avg(pow(returns - m, 2)), 2) AS kurt FROM c GROUP BY 1),
  z AS (SELECT symbol, coalesce(n < 3 OR sd < 1e-12, true) AS flat, (sr - sqrt((1 + 0.5 * sr * sr) / n) * best) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS z FROM k, best)
  SELECT symbol, CASE WHEN flat THEN 0.0 ELSE round({normal('z')}, 6) + 0.0 END AS dsr FROM z"""
