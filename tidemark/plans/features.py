"""Queries of window features: one ticker's bars (W) and across tickers (X)."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from ..operators import price, quality
from ..functions.exprs import ahead, pct as spark_pct
from ..sources.views import common_grid
from .catalog import W, ewm, lag, on_bars, pct, roll

RET = f"r AS (SELECT *, {pct('close')} AS ret FROM bars)\n====\n"

on_bars("w1_returns", price.returns, [], ["ret_1"], f"\n====\nSELECT ticker, date, {pct('close')} AS ret_1 FROM bars")
on_bars("w2_next_day_targets", price.next_day_targets, [], ["next_ret"], f"{RET}SELECT ticker, date, lead(ret) OVER ({W}) AS next_ret FROM r")
on_bars("w3_lags", lambda b: price.lagged(b, ["close", "nothing"], (1, 5)), [], ["close_lag_1", "close_lag_5"], f"\n====\nSELECT ticker, date, {lag('close')} AS close_lag_1, {lag('close', 5)} AS close_lag_5 FROM bars")
on_bars("w4_price_ranges", price.ranges, [], ["high_low", "close_open", "close_place"], "\n====\nSELECT ticker, date, high - low AS high_low, close - open AS close_open, coalesce((close - low) / nullif(high - low, 0), 0.5) AS close_place FROM bars")
TR = f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
on_bars("w5_true_range", lambda b: b.withColumn("true_range", price.true_range()), [], ["true_range"], f"\n====\nSELECT ticker, date, {TR} AS true_range FROM bars")
on_bars("w7_volume_features", price.volume_features, [], ["volume_change", "volume_mean", "volume_ratio"], f"m AS (SELECT *, {roll('avg', 'volume', 20, 1)} AS m FROM bars)\n====\nSELECT ticker, date, {pct('volume')} * 100 AS volume_change, m AS volume_mean, volume / nullif(m, 0) AS volume_ratio FROM m")
on_bars("w8_on_balance_volume", price.on_balance_volume, [], ["obv"], f"s AS (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS s FROM bars)\n====\nSELECT ticker, date, sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM s")
on_bars("w10_simple_averages", lambda b: price.moving_averages(b, (10, 20, 50)), [], ["sma_10", "sma_20", "sma_50"], f"\n====\nSELECT ticker, date, {', '.join(f'{roll('avg', 'close', n)} AS sma_{n}' for n in (10, 20, 50))} FROM bars")
BB = f"m AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)\n====\n"
on_bars("w12_bollinger_bands", price.bollinger, [], ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_place"], f"{BB}SELECT ticker, date, m AS bb_mid, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, (m + 2 * s - (m - 2 * s)) / (m + 1e-9) AS bb_width, (close - (m - 2 * s)) / nullif(m + 2 * s - (m - 2 * s), 0) AS bb_place FROM m")
STOCH = f"x AS (SELECT *, {roll('min', 'low', 14)} AS lo, {roll('max', 'high', 14)} AS hi FROM bars), k AS (SELECT *, (close - lo) / nullif(hi - lo, 0) * 100 AS k FROM x)\n====\n"
on_bars("w13_stochastic", price.stochastic, [], ["stoch_k", "stoch_d"], f"{STOCH}SELECT ticker, date, k AS stoch_k, {roll('avg', 'k', 3)} AS stoch_d FROM k")
on_bars("w16_calendar", price.calendar, ["day_of_week", "month"], [], "\n====\nSELECT ticker, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month FROM bars")
on_bars("w17_mean_convergence", price.mean_convergence, [], ["mean_convergence"], f"\n====\nSELECT ticker, date, close / ({roll('avg', 'close', 50)} + 1e-6) AS mean_convergence FROM bars")
on_bars("w18_rate_of_change", price.rate_of_change, [], ["roc"], f"\n====\nSELECT ticker, date, {pct('close', 12)} * 100 AS roc FROM bars")
MFI = f"t AS (SELECT *, (high + low + close) / 3 AS t FROM bars), p AS (SELECT *, {lag('t')} AS p FROM t), f AS (SELECT *, CASE WHEN t > p THEN t * volume ELSE 0 END AS up, CASE WHEN t < p THEN t * volume ELSE 0 END AS down FROM p)\n====\n"
on_bars("w19_money_flow", price.money_flow, [], ["mfi"], f"{MFI}SELECT ticker, date, 100 - 100 / (1 + {roll('sum', 'up', 14)} / nullif({roll('sum', 'down', 14)}, 0)) AS mfi FROM f", 4)
CMF = "f AS (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS f FROM bars)\n====\n"
on_bars("w20_chaikin_flow", price.chaikin, [], ["cmf"], f"{CMF}SELECT ticker, date, ({roll('sum', 'f', 21)}) / nullif({roll('sum', 'volume', 21)}, 0) AS cmf FROM f")

R20 = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
EVENT = f"""e AS (SELECT *, {pct('close')} AS ret_1, {pct('close', 5)} AS ret_5, {pct('close', 20)} AS ret_20, {pct('open')} AS o1, {lag('close')} AS before,
    greatest(coalesce(close - {lag('close')}, 0), 0) AS g, greatest(coalesce({lag('close')} - close, 0), 0) AS l,
    {roll('avg', 'close', 20)} AS m20, {roll('avg', 'close', 50)} AS m50, {roll('min', 'close', 14)} AS lo, {roll('max', 'close', 14)} AS hi FROM bars),
  v AS (SELECT *, {roll('stddev_samp', 'ret_1', 20)} AS vol_20, {roll('stddev_samp', 'ret_1', 60)} AS vol_60, {roll('avg', 'g', 14)} AS up, {roll('avg', 'l', 14)} AS down FROM e)
====
SELECT ticker, date, ret_1, ret_5, ret_20, vol_20, vol_60, vol_20 / nullif(vol_60, 0) AS vol_ratio, close / m20 - 1 AS dist_20, close / m50 - 1 AS dist_50,
  (close - m20) / (2 * vol_20 * before + 1e-9) AS bb_pos, (close - lo) / nullif(hi - lo, 0) AS stoch_close, up / (up + down + 1e-9) AS rsi_simple, o1 - ret_1 AS overnight,
  CASE WHEN count(ret_1) OVER {R20} >= 20 THEN skewness(ret_1) OVER {R20} END AS skew_20,
  CASE WHEN count(ret_1) OVER {R20} >= 20 THEN kurtosis(ret_1) OVER {R20} END AS kurt_20 FROM v"""
on_bars("w22_w23_event_time", price.event_time, [], ["ret_1", "ret_5", "ret_20", "vol_20", "vol_60", "vol_ratio", "dist_20", "dist_50", "bb_pos", "stoch_close", "rsi_simple", "skew_20", "kurt_20", "overnight"], EVENT, 5)
on_bars("w24_volume_shock", price.volume_shock, [], ["volume_z", "volume_short_ratio"], f"\n====\nSELECT ticker, date, (volume - {roll('avg', 'volume', 60)}) / ({roll('stddev_samp', 'volume', 60)} + 1e-9) AS volume_z, ({roll('avg', 'volume', 5)}) / nullif({roll('avg', 'volume', 60)}, 0) AS volume_short_ratio FROM bars")
on_bars("w26_drawdown", price.drawdown, [], ["drawdown"], f"\n====\nSELECT ticker, date, close / ({roll('max', 'close', 252)} + 1e-9) - 1 AS drawdown FROM bars")
RUNS = f"n AS (SELECT *, CASE WHEN volume = {lag('volume')} THEN 0 ELSE 1 END AS n FROM bars), g AS (SELECT *, sum(n) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM n)\n====\n"
on_bars("w27_days_since_change", lambda b: price.days_since_change(b, "volume"), ["days_since_change"], [], f"{RUNS}SELECT ticker, date, CAST(row_number() OVER (PARTITION BY ticker, g ORDER BY date) - 1 AS INTEGER) AS days_since_change FROM g")
STREAK = f"s AS (SELECT *, CAST(coalesce(sign(close - {lag('close')}), 0) AS INTEGER) AS s FROM bars), n AS (SELECT *, CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS n FROM s), g AS (SELECT *, sum(n) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM n), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, g ORDER BY date) AS INTEGER) AS p FROM g)\n====\n"
on_bars("w28_streaks", price.streaks, ["up_streak", "down_streak"], [], f"{STREAK}SELECT ticker, date, CASE WHEN s > 0 THEN p ELSE 0 END AS up_streak, CASE WHEN s < 0 THEN p ELSE 0 END AS down_streak FROM p")
PARK = f"x AS (SELECT *, pow(ln(greatest(high / nullif(low, 0), 1e-9)), 2) / {4 * log(2)!r} AS x FROM bars)\n====\n"
on_bars("w29_range_volatility", price.parkinson, [], ["range_vol"], f"{PARK}SELECT ticker, date, {roll('avg', 'x', 20)} AS range_vol FROM x")
AC = f"r AS (SELECT *, {pct('close')} AS r FROM bars), b AS (SELECT *, {lag('r')} AS b FROM r)\n====\n"
on_bars("w30_autocorrelation", price.autocorrelation, [], ["autocorr"], f"{AC}SELECT ticker, date, CASE WHEN count(r) OVER {R20} >= 20 THEN corr(r, b) OVER ({W} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) END AS autocorr FROM b")
ILL = f"v AS (SELECT *, nullif(volume, 0) AS v, abs({pct('close')}) / nullif(volume, 0) AS a FROM bars), i AS (SELECT *, {roll('avg', 'a', 20)} AS i, v / nullif({roll('sum', 'v', 20)}, 0) AS t FROM v)\n====\n"
on_bars("w31_illiquidity", price.illiquidity, [], ["amihud", "turnover"], f"{ILL}SELECT ticker, date, {lag('i')} AS amihud, {lag('t')} AS turnover FROM i")
ILV = f"a AS (SELECT *, abs({pct('close')}) / (close * volume + 1e-12) AS a FROM bars)\n====\n"
on_bars("w32_illiquidity_by_value", price.illiquidity_by_value, [], ["amihud_value", "turnover_max"], f"{ILV}SELECT ticker, date, {roll('avg', 'a', 20)} AS amihud_value, volume / ({roll('max', 'volume', 20)} + 1e-12) AS turnover_max FROM a", 9)

# recursions: exponential weights by a fold over the rows so far
DM = f"d AS (SELECT *, {TR} AS tr, greatest(coalesce(close - {lag('close')}, 0), 0) AS g, greatest(coalesce({lag('close')} - close, 0), 0) AS l, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM bars), m AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS n FROM d)"
on_bars("w6_average_true_range", price.recursions, [], ["atr_14"], f"{DM}\n====\nSELECT ticker, date, {ewm('tr', 14, 14)} AS atr_14 FROM m", 4)
on_bars("w9_relative_strength_index", price.recursions, [], ["rsi_14"], f"{DM}, e AS (SELECT *, {ewm('g', 14, 14)} AS ag, {ewm('l', 14, 14)} AS al FROM m)\n====\nSELECT ticker, date, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi_14 FROM e", 4)
on_bars("w11_exponential_averages", price.recursions, [], ["ema_12", "ema_26"], f"\n====\nSELECT ticker, date, {ewm('close', 12)} AS ema_12, {ewm('close', 26)} AS ema_26 FROM bars", 4)
on_bars("w14_directional_index", price.recursions, [], ["di_plus", "di_minus", "adx_14"], f"{DM}, e AS (SELECT *, {ewm('tr', 14, 14)} AS st, {ewm('p', 14)} AS sp, {ewm('n', 14)} AS sn FROM m), x AS (SELECT *, coalesce(100 * abs(sp - sn) / nullif(sp + sn, 0) + 0 * st, 0) AS dx FROM e)\n====\nSELECT ticker, date, sp / nullif(st, 0) * 100 AS di_plus, sn / nullif(st, 0) * 100 AS di_minus, {ewm('dx', 14)} AS adx_14 FROM x", 4)
on_bars("w15_macd", price.recursions, [], ["macd", "macd_signal", "macd_hist"], f"e AS (SELECT *, {ewm('close', 12, 12)} - {ewm('close', 26, 26)} AS m FROM bars), s AS (SELECT *, {ewm('m', 9, 9)} AS s FROM e)\n====\nSELECT ticker, date, m AS macd, s AS macd_signal, m - s AS macd_hist FROM s", 4)
on_bars("w25_gaps", lambda b: price.gaps(price.recursions(b)), [], ["gap", "gap_by_atr"], f"{DM}, a AS (SELECT *, {ewm('tr', 14, 14)} AS atr, {lag('close')} AS c1 FROM m)\n====\nSELECT ticker, date, (open - c1) / nullif(c1, 0) AS gap, abs((open - c1) / nullif(c1, 0)) / nullif(atr / nullif(c1, 0), 0) AS gap_by_atr FROM a", 5)
INTER = f"{DM}, e AS (SELECT *, {ewm('g', 14, 14)} AS ag, {ewm('l', 14, 14)} AS al, {ewm('close', 12, 12)} - {ewm('close', 26, 26)} AS macd, volume / nullif({roll('avg', 'volume', 20, 1)}, 0) AS vr, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM m), f AS (SELECT *, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi, (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS bb FROM e)\n====\n"
on_bars("w21_interactions", lambda b: price.interactions(price.bollinger(price.volume_features(price.recursions(b)))), [], ["rsi_volume", "bb_rsi", "macd_volume", "macd_by_close", "range_volume"], f"{INTER}SELECT ticker, date, rsi * vr AS rsi_volume, bb * rsi AS bb_rsi, macd * vr AS macd_volume, macd / close AS macd_by_close, tr * volume AS range_volume FROM f", 3)
KALMAN = f"""RECURSIVE z AS (SELECT ticker, date, close, row_number() OVER ({W}) AS n FROM bars),
  f AS (SELECT ticker, date, n, close AS m, 0.5::DOUBLE AS p FROM z WHERE n = 1
    UNION ALL SELECT z.ticker, z.date, z.n, f.m + (f.p + 0.01) / (f.p + 0.01 + 1.0) * (z.close - f.m), (f.p + 0.01) * (1 - (f.p + 0.01) / (f.p + 0.01 + 1.0)) FROM f JOIN z ON z.ticker = f.ticker AND z.n = f.n + 1)
====
SELECT ticker, date, lag(m, 1) OVER ({W}) AS level_lag_1, lag(m, 5) OVER ({W}) AS level_lag_5, lag(m, 10) OVER ({W}) AS level_lag_10 FROM f"""
# the recursive table is named before the views that it uses, which SQL allows
on_bars("w33_local_level", price.local_level, [], ["level_lag_1", "level_lag_5", "level_lag_10"], KALMAN.replace("FROM bars)", "FROM bars)", 1), 4)
on_bars("w34_late_columns", lambda b: price.late(price.bollinger(price.parkinson(b)), price.LEAKY), [], ["range_vol", "bb_mid"], f"x AS (SELECT *, pow(ln(greatest(high / nullif(low, 0), 1e-9)), 2) / {4 * log(2)!r} AS x FROM bars), y AS (SELECT *, {roll('avg', 'x', 20)} AS v, {roll('avg', 'close', 20)} AS m FROM x)\n====\nSELECT ticker, date, {lag('v')} AS range_vol, {lag('m')} AS bb_mid FROM y")
on_bars("c1_base_features", price.base_features, [], ["atr_14", "rsi_14", "macd", "vol_20", "level_lag_1"], None, 4)

# across tickers
BENCH = "1-URGENT"
GRID = "g AS (SELECT * FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)))"
W60 = f"({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
W5 = f"({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
REL = f"""{GRID}, t AS (SELECT *, {pct('close')} AS ret, {TR} AS tr FROM g), u AS (SELECT *, {roll('avg', 'tr', 14)} AS range_14 FROM t),
  j AS (SELECT u.*, b.ret AS b_ret, b.close AS b_close, b.volume AS b_volume, b.range_14 AS b_range, CASE WHEN u.ret IS NOT NULL AND b.ret IS NOT NULL THEN 1 END AS pair FROM u JOIN u AS b ON u.date = b.date AND b.ticker = '{BENCH}' AND u.ticker <> '{BENCH}')
====
SELECT ticker, date, ret / (b_ret + 1e-9) AS strength, ret - b_ret AS excess,
  CASE WHEN count(pair) OVER {W60} >= 60 THEN covar_samp(ret, b_ret) OVER {W60} / (var_samp(b_ret) OVER {W60} + 1e-12) END AS beta,
  CASE WHEN count(pair) OVER {W60} >= 60 THEN corr(ret, b_ret) OVER {W60} END AS corr,
  CASE WHEN count(pair) OVER {W5} >= 5 THEN corr(ret, b_ret) OVER {W5} END AS corr_5,
  close / (b_close + 1e-9) AS price_ratio, volume / nullif(b_volume, 0) AS volume_ratio, range_14 / nullif(b_range, 0) AS range_ratio, volume * range_14 AS volume_range, close - b_close AS spread FROM j"""
REL_COLUMNS = ["strength", "excess", "beta", "corr", "corr_5", "price_ratio", "volume_ratio", "range_ratio", "volume_range", "spread"]
on_bars("x1_to_x12_relatives", lambda b: price.relative(common_grid(b), BENCH), [], REL_COLUMNS, REL, 4)
PAIR = f"a AS (SELECT *, {pct('close')} AS ret FROM bars)\n====\nSELECT a.ticker, a.date, a.close - b.close AS spread, a.close / (b.close + 1e-9) AS ratio FROM a JOIN a AS b ON a.date = b.date AND a.ticker = '2-HIGH' AND b.ticker = '{BENCH}'"
on_bars("x2_x7_pair", lambda b: price.cross_pair(b, "2-HIGH", BENCH).withColumns({"spread": F.col("close") - F.col("o_close"), "ratio": F.col("close") / (F.col("o_close") + 1e-9)}), [], ["spread", "ratio"], PAIR)


def _ic(b):
    b = price.mean_convergence(price.rate_of_change(b))
    return b.withColumn("_r", spark_pct("close")).withColumn("next_ret", ahead("_r"))


IC = f"f AS (SELECT ticker, date, {pct('close', 12)} * 100 AS roc, close / ({roll('avg', 'close', 50)} + 1e-6) AS mean_convergence, {pct('close')} AS ret FROM bars), n AS (SELECT *, lead(ret) OVER ({W}) AS next_ret FROM f), u AS (SELECT ticker, date, next_ret, 'roc' AS feature, roc AS x FROM n UNION ALL SELECT ticker, date, next_ret, 'mean_convergence', mean_convergence FROM n)"
WF = "(PARTITION BY ticker, feature ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
ICS = f"{IC}, i AS (SELECT ticker, date, feature, CASE WHEN count(CASE WHEN x IS NOT NULL AND next_ret IS NOT NULL THEN 1 END) OVER {WF} >= 60 THEN corr(x, next_ret) OVER {WF} END AS ic FROM u)"
on_bars("x13_rolling_ic", lambda b: quality.ic_series(_ic(b), ["roc", "mean_convergence"], "next_ret"), ["feature"], ["ic"], f"{ICS}\n====\nSELECT * FROM i")
on_bars("a16_ic_summary", lambda b: quality.ic_summary(quality.ic_series(_ic(b), ["roc", "mean_convergence"], "next_ret")), ["feature"], ["median", "iqr", "positive", "ir"], f"{ICS}\n====\nSELECT ticker, feature, quantile_cont(ic, 0.5) AS median, quantile_cont(ic, 0.75) - quantile_cont(ic, 0.25) AS iqr, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, quantile_cont(ic, 0.5) / (stddev_samp(ic) + 1e-12) * sqrt(252) AS ir FROM i GROUP BY ticker, feature", keys=("ticker",))
RANKS = f"""r AS (SELECT ticker, date, {pct('close')} AS x, {pct('volume')} AS y FROM bars), k AS (SELECT *, row_number() OVER ({W}) AS k FROM r),
  w AS (SELECT a.ticker, a.date, a.k, b.x, b.y FROM k a JOIN k b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 19 AND a.k AND b.x IS NOT NULL AND b.y IS NOT NULL),
  q AS (SELECT ticker, date, rank() OVER (PARTITION BY ticker, k ORDER BY x) + (count(*) OVER (PARTITION BY ticker, k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY ticker, k ORDER BY y) + (count(*) OVER (PARTITION BY ticker, k, y) - 1) / 2.0 AS ry FROM w),
  c AS (SELECT ticker, date, CASE WHEN count(*) >= 20 AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) END AS ic FROM q GROUP BY 1, 2)
====
SELECT r.ticker, r.date, c.ic FROM r LEFT JOIN c ON r.ticker = c.ticker AND r.date = c.date"""
on_bars("x14_rank_ic", lambda b: quality.rank_ic_series(b.withColumns({"x": spark_pct("close"), "y": spark_pct("volume")}), "x", "y"), [], ["ic"], RANKS)
TOPK = f"{RET.replace(chr(10) + '====' + chr(10), '')}, k AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) AS k FROM r WHERE ret IS NOT NULL), s AS (SELECT date, list(ticker) AS s FROM k WHERE k <= 2 GROUP BY date), p AS (SELECT date, s, lag(s) OVER (ORDER BY date) AS p FROM s)\n====\nSELECT date, 1 - len(list_intersect(s, p)) / (len(p) + 1e-9) AS turnover FROM p WHERE p IS NOT NULL"
on_bars("x15_topk_turnover", lambda b: quality.topk_turnover(price.returns(b), "ret_1", 2), [], ["turnover"], TOPK, keys=("date",))
on_bars("c2_target_view", lambda b: price.relative(common_grid(price.volume_features(b).select("ticker", "date", "open", "high", "low", "close", "volume")), "2-HIGH"), [], ["strength", "beta", "spread"], None, 4)

GRID = "g AS (SELECT * FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)))"
W60 = f"({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def beta_sql(c: str) -> str:
    return f"CASE WHEN count(CASE WHEN ret IS NOT NULL AND {c} IS NOT NULL THEN 1 END) OVER {W60} >= 60 THEN covar_samp(ret, {c}) OVER {W60} / (var_samp(CASE WHEN ret IS NOT NULL THEN {c} END) OVER {W60} + 1e-12) END"


TWO = f"{GRID}, r AS (SELECT ticker, date, {pct('close')} AS ret FROM g), j AS (SELECT r.ticker, r.date, r.ret, s.ret AS sr, m.ret AS mr FROM r LEFT JOIN r s ON s.date = r.date AND s.ticker = '2-HIGH' LEFT JOIN r m ON m.date = r.date AND m.ticker = '3-MEDIUM')\n====\nSELECT ticker, date, ret / (sr + 1e-9) AS sector_strength, ret / (mr + 1e-9) AS market_strength, {beta_sql('sr')} AS sector_beta, {beta_sql('mr')} AS market_beta FROM j"
on_bars("x9_x10_two_relatives", lambda b: price.two_relatives(common_grid(b), "2-HIGH", "0-MISSING", (None, "3-MEDIUM")), [], ["sector_strength", "sector_beta", "market_strength", "market_beta"], TWO, 4)
