"""Queries of labels, splits, decisions, metrics, simulations and models (T, A19 to A30, E, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import ahead, pct as spark_pct, roll as spark_roll
from ..operators import align, labels, learning, price, quality, simulation
from ..sources.views import table
from ..streaming import streams
from .catalog import SQL, W, add, lag, on_bars, pct, roll

FWD5 = f"f AS (SELECT ticker, date, close, lead(close, 5) OVER ({W}) / nullif(close, 0) - 1 AS fwd FROM bars)"
on_bars("t1_binary_target", lambda b: labels.binary_target(b, 5, 0.01), ["target"], [], f"{FWD5}\n====\nSELECT ticker, date, coalesce((fwd > 0.01)::INT, 0) AS target FROM f")
on_bars("t2_three_classes", lambda b: labels.class_target(b, 5, 0.05), ["target"], [], f"{FWD5}\n====\nSELECT ticker, date, CASE WHEN fwd > 0.05 THEN 1 WHEN fwd >= -0.05 THEN 0 ELSE -1 END AS target FROM f")
on_bars("t2_five_classes", lambda b: labels.class_target(b, 5, 0.05, 0.3), ["target"], [], f"{FWD5}\n====\nSELECT ticker, date, CASE WHEN fwd <= -0.3 THEN 4 WHEN fwd >= 0.3 THEN 3 WHEN fwd < -0.05 THEN 0 WHEN fwd BETWEEN -0.05 AND 0.05 THEN 1 ELSE 2 END AS target FROM f")
on_bars("t3_regression_target", lambda b: b.withColumn("fwd", labels.forward_return(5)), [], ["fwd"], f"{FWD5}\n====\nSELECT ticker, date, fwd FROM f")
on_bars("t5_vertical_barriers", lambda b: labels.vertical_barriers(b, 10), ["t1"], [], f"\n====\nSELECT ticker, date, coalesce(lead(date, 10) OVER ({W}), max(date) OVER (PARTITION BY ticker)) AS t1 FROM bars")
# T4: weights d^age of the n values so far; their corrected variance
D = 1 - 2 / 21
VOL = f"""l AS (SELECT *, ln(close / nullif({lag('close')}, 0)) AS lr, row_number() OVER ({W}) AS k FROM bars),
  x AS (SELECT ticker, date, close, k, list(lr) FILTER (WHERE lr IS NOT NULL) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM l),
  w AS (SELECT *, list_transform(range(len(xs)), lambda i: pow({D!r}, len(xs) - 1 - i)) AS ws FROM x),
  m AS (SELECT *, list_sum(ws) AS sw, list_sum(list_transform(ws, lambda v: v * v)) AS sw2, list_sum(list_transform(list_zip(ws, xs), lambda z: z[1] * z[2])) / list_sum(ws) AS mu FROM w),
  v AS (SELECT ticker, date, close, k, CASE WHEN len(xs) >= 20 THEN sqrt(list_sum(list_transform(list_zip(ws, xs), lambda z: z[1] * (z[2] - mu) * (z[2] - mu))) / sw * sw * sw / (sw * sw - sw2)) END AS vol FROM m)"""
on_bars("t4_daily_volatility", labels.daily_volatility, [], ["vol"], f"{VOL}\n====\nSELECT ticker, date, vol FROM v")
BARRIER = f"""{{first}}, e AS (SELECT *, lead(date, 1) OVER ({W}) AS d1 FROM {{rows}}),
  p AS (SELECT a.ticker, a.date AS t, a.trgt, a.side, b.date AS d, b.k - a.k AS step, ln(b.close / a.close) * coalesce(a.side, 1) AS r FROM e a JOIN e b ON a.ticker = b.ticker AND b.k BETWEEN a.k + 1 AND a.k + 10 WHERE a.trgt IS NOT NULL),
  h AS (SELECT *, r >= {{up}} * trgt OR r <= -{{up}} * trgt AS hit FROM p),
  f AS (SELECT ticker, t, coalesce(min(step) FILTER (WHERE hit), max(step)) AS step FROM h GROUP BY 1, 2)
====
SELECT h.ticker, h.t, h.d AS t1, h.r AS ret, CASE WHEN NOT h.hit THEN 'tl' WHEN h.r <= -{{up}} * h.trgt THEN 'sl' ELSE 'pt' END AS type, CAST(CASE WHEN abs(h.r) < 1e-12 THEN 0 ELSE sign(h.r) END AS INTEGER) AS bin{{more}} FROM h JOIN f ON h.ticker = f.ticker AND h.t = f.t AND h.step = f.step"""
on_bars("t6_t7_primary_labels", lambda b: labels.primary_labels(b, 10, 1.0, 1.0, 0.0), ["t", "t1", "type", "bin"], ["ret"], BARRIER.format(first=f"{VOL}, y AS (SELECT *, CASE WHEN vol > 0 THEN vol END AS trgt, CAST(NULL AS DOUBLE) AS side FROM v)", rows="y", up=1.0, more=""), keys=("ticker",))
CROSS = f"s AS (SELECT ticker, date, close, k, vol, sign({roll('avg', 'close', 5)} - {roll('avg', 'close', 20)}) AS d FROM v), c AS (SELECT *, CASE WHEN d > 0 AND {lag('d')} <= 0 THEN 1.0 WHEN d < 0 AND {lag('d')} >= 0 THEN -1.0 ELSE 0.0 END AS side FROM s)"
on_bars("t10_ma_cross", lambda b: labels.ma_cross(b, 5, 20), [], ["side"], f"s AS (SELECT ticker, date, sign({roll('avg', 'close', 5)} - {roll('avg', 'close', 20)}) AS d FROM bars)\n====\nSELECT ticker, date, CASE WHEN d > 0 AND {lag('d')} <= 0 THEN 1.0 WHEN d < 0 AND {lag('d')} >= 0 THEN -1.0 ELSE 0.0 END AS side FROM s")
on_bars("t8_meta_labels", lambda b: labels.meta_labels(b, 10, 0.5, 0.5), ["t", "t1", "type", "bin", "y"], ["ret"], BARRIER.format(first=f"{VOL}, {CROSS}, y AS (SELECT *, CASE WHEN side <> 0 THEN vol END AS trgt FROM c)", rows="y", up=0.5, more=", (h.r > 0)::INT AS y"), keys=("ticker",))


def datasets(b: DataFrame, horizon: int = 10) -> DataFrame:
    """T9: labels of all but the last rows, those that moved, with weights by target."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    kept = b.withColumn("_k", back).where(F.col("_k") > horizon).drop("_k")
    rows = labels.primary_labels(kept, horizon, 1.0, 1.0, 0.0).where("bin <> 0")
    return labels.class_weights(labels.event_weights(rows.withColumn("y", (F.col("bin") > 0).cast("int"))))


on_bars("t9_a23_a24_datasets", datasets, ["t", "bin", "y"], ["weight", "class_weight"], None, keys=("ticker",))
PROBA = "0.5 + 0.5 * ((CAST(strftime(date, '%d') AS INTEGER) * 37 % 31) / 31.0 - 0.3)"


def events(b: DataFrame) -> DataFrame:
    """Bars with a side, a stand-in for a probability that depends on the day, and the next return."""
    p = 0.5 + 0.5 * ((F.dayofmonth("date") * 37 % 31) / 31.0 - 0.3)
    b = b.withColumns({"proba": p, "side": F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0), "_r": spark_pct("close")})
    return b.withColumn("ret", ahead("_r"))


EVENTS = f"r AS (SELECT *, {pct('close')} AS r FROM bars), e AS (SELECT ticker, date, open, low, close, {PROBA} AS proba, CASE WHEN close > open THEN 1.0 ELSE -1.0 END AS side, lead(r) OVER ({W}) AS ret FROM r)"
on_bars("t11_meta_decision", lambda b: labels.decide(events(b), 0.6), [], ["signal"], f"{EVENTS}\n====\nSELECT ticker, date, CASE WHEN proba >= 0.6 THEN side ELSE 0.0 END AS signal FROM e")
GRIDS = f"""{EVENTS}, g AS (SELECT e.*, t, CASE WHEN proba >= t THEN side * ret ELSE 0.0 END AS pnl FROM e, (SELECT 0.5::DOUBLE + i * 0.025::DOUBLE AS t FROM range(9) x(i))),
  n AS (SELECT *, pnl - 0.0005 * coalesce(abs((pnl <> 0)::INT - lag((pnl <> 0)::INT) OVER (PARTITION BY ticker, t ORDER BY date)), 0) AS net FROM g),
  s AS (SELECT ticker, t, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe FROM n GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, t) AS k FROM s)
====
SELECT ticker, t AS threshold, sharpe FROM k WHERE k = 1"""
on_bars("t12_best_threshold", lambda b: labels.best_threshold(events(b)), [], ["threshold", "sharpe"], GRIDS, keys=("ticker",))
# few events reach 0.85: tickers go down the quantiles until five do
FALLBACK = f"{EVENTS}, q AS (SELECT ticker, quantile_cont(proba, [0.98, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55]) AS q FROM e GROUP BY 1), t AS (SELECT ticker, unnest(list_concat([0.84], q)) AS cut, generate_subscripts(list_concat([0.84], q), 1) AS k FROM q), n AS (SELECT t.ticker, t.k, t.cut, count(*) FILTER (WHERE e.proba >= t.cut) AS n FROM t JOIN e ON e.ticker = t.ticker GROUP BY 1, 2, 3)\n====\nSELECT ticker, coalesce(arg_min(cut, k) FILTER (WHERE n >= 5), 0.84) AS threshold FROM n GROUP BY 1"
on_bars("t13_threshold_with_trades", lambda b: labels.threshold_with_trades(events(b), b.select("ticker").distinct().withColumn("threshold", F.lit(0.84))), [], ["threshold"], FALLBACK, keys=("ticker",))
NTH = f"n AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"
PURGED = f"""t AS (SELECT *, coalesce(lead(date, 10) OVER ({W}), max(date) OVER (PARTITION BY ticker)) AS t1, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars),
  x AS (SELECT t.*, i AS fold, n - (3 - i) * 50 AS lo FROM t, range(3) r(i)), y AS (SELECT *, min(CASE WHEN pos = lo THEN date END) OVER (PARTITION BY ticker, fold) AS start FROM x),
  z AS (SELECT ticker, CAST(fold AS INTEGER) AS fold, date, CASE WHEN pos >= lo AND pos < lo + 50 THEN 'test' WHEN pos < lo AND t1 < start THEN 'train' END AS role FROM y WHERE lo > 0)
====
SELECT ticker, fold, role, date FROM z WHERE role IS NOT NULL"""
on_bars("t14_purged_splits", lambda b: labels.purged_splits(labels.vertical_barriers(b, 10), 3, 50), ["fold", "role"], [], PURGED)
on_bars("t15_block_splits", lambda b: labels.block_splits(b, 4, 5, 3), ["fold", "role"], [], f"{NTH}, x AS (SELECT *, i AS fold, i * (n // 4) AS lo, CASE WHEN i = 3 THEN n ELSE (i + 1) * (n // 4) END AS hi FROM n, range(4) r(i)), z AS (SELECT ticker, CAST(fold AS INTEGER) AS fold, date, CASE WHEN pos >= lo AND pos < hi THEN 'test' WHEN pos < lo - 5 OR pos >= hi + 3 THEN 'train' END AS role FROM x)\n====\nSELECT * FROM z WHERE role IS NOT NULL")
on_bars("t16_split_dates", labels.split_dates, ["train_end", "valid_end"], [], f"{NTH}\n====\nSELECT ticker, max(CASE WHEN pos = greatest(CAST(floor(0.75::DOUBLE * n) AS BIGINT) - 1, 0) THEN date END) AS train_end, max(CASE WHEN pos = greatest(CAST(floor(0.9::DOUBLE * n) AS BIGINT) - 1, 0) THEN date END) AS valid_end FROM n GROUP BY 1", keys=("ticker",))
on_bars("t17_expanding_splits", lambda b: labels.expanding_splits(b, 4, 2), ["fold", "role"], [], f"{NTH}, x AS (SELECT *, i AS fold, n - (4 - i) * (n // 5) AS lo FROM n, range(4) r(i)), z AS (SELECT ticker, CAST(fold AS INTEGER) AS fold, date, CASE WHEN pos >= lo AND pos < lo + n // 5 THEN 'test' WHEN pos < lo - 2 THEN 'train' END AS role FROM x)\n====\nSELECT * FROM z WHERE role IS NOT NULL")
PNL = f"{EVENTS}\n====\nSELECT ticker, date, CASE WHEN proba >= 0.6 THEN side ELSE 0.0 END AS signal, coalesce(CASE WHEN proba >= 0.6 THEN side ELSE 0.0 END * ret, 0) AS pnl FROM e"


def pnl(b: DataFrame) -> DataFrame:
    return labels.daily_pnl(b, labels.decide(events(b), 0.6).where("signal <> 0").select("ticker", "date", "signal"))


on_bars("t18_daily_pnl", pnl, [], ["signal", "pnl"], PNL)

# metrics
on_bars("a19_a20_pnl_and_sharpe", lambda b: (lambda e: e.groupBy("ticker").agg(F.sum(F.col("side") * F.col("ret")).alias("pnl"), quality.sharpe(e, "ret").alias("sharpe")))(events(b)), [], ["pnl", "sharpe"], f"{EVENTS}\n====\nSELECT ticker, sum(side * ret) AS pnl, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe FROM e GROUP BY 1", keys=("ticker",))
NET = f"{EVENTS}, h AS (SELECT ticker, date, CASE WHEN proba >= 0.6 THEN side * ret ELSE 0.0 END AS p FROM e), n AS (SELECT *, p - 0.001 * coalesce(abs((coalesce(p, 0) <> 0)::INT - lag((coalesce(p, 0) <> 0)::INT) OVER ({W})), 0) AS net FROM h)\n====\nSELECT ticker, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe FROM n GROUP BY 1"


def net_sharpe(b: DataFrame) -> DataFrame:
    n = quality.net_of_costs(events(b).withColumn("p", F.when(F.col("proba") >= 0.6, F.col("side") * F.col("ret")).otherwise(0.0)), "p", 0.001)
    return n.groupBy("ticker").agg(quality.sharpe(n, "net").alias("sharpe"))


on_bars("a21_sharpe_with_costs", net_sharpe, [], ["sharpe"], NET, keys=("ticker",))
DRAW = f"r AS (SELECT ticker, date, coalesce({pct('close')}, 0) AS r FROM bars), e AS (SELECT *, exp(sum(ln(1 + r)) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS e FROM r), p AS (SELECT *, max(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS p FROM e)\n====\nSELECT ticker, max(1 - e / p) AS max_drawdown FROM p GROUP BY 1"
on_bars("a22_max_drawdown", lambda b: quality.max_drawdown(price.returns(b), "ret_1"), [], ["max_drawdown"], DRAW, keys=("ticker",))
on_bars("a27_return_metrics", lambda b: quality.return_metrics(b, "close"), ["days"], ["total", "annual"], "a AS (SELECT ticker, arg_max(close, date) / arg_min(close, date) - 1 AS total, count(*) AS days FROM bars GROUP BY 1)\n====\nSELECT ticker, days, total, pow(1 + total, 252.0::DOUBLE / days) - 1 AS annual FROM a", keys=("ticker",))
on_bars("a28_decision_metrics", lambda b: quality.decision_metrics(pnl(b)), ["trades"], ["exposure", "hit_rate", "pnl"], PNL.replace("\n====\n", ", q AS (") + ")\n====\nSELECT ticker, count(CASE WHEN signal <> 0 THEN 1 END) AS trades, count(CASE WHEN signal <> 0 THEN 1 END) / count(*) AS exposure, count(CASE WHEN pnl > 0 THEN 1 END) / nullif(count(CASE WHEN signal <> 0 THEN 1 END), 0) AS hit_rate, sum(pnl) AS pnl FROM q GROUP BY 1", keys=("ticker",))
FIRST = f"first_value(close) OVER ({W})"
on_bars("a29_buy_and_hold", lambda b: quality.buy_and_hold(b, 1e7), [], ["equity"], f"\n====\nSELECT ticker, date, floor(1e7 / {FIRST}) * close + (1e7 - floor(1e7 / {FIRST}) * {FIRST}) AS equity FROM bars", 4)
YP = f"y AS (SELECT ticker, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS y, proba AS p FROM e WHERE ret IS NOT NULL)"
on_bars("e16_classification_metrics", lambda b: quality.classification_metrics(events(b).where("ret is not null").withColumn("y", (F.col("ret") > 0).cast("int")), "proba", "y"), [], ["accuracy", "precision", "recall", "f1", "brier", "log_loss"], f"{EVENTS}, {YP}\n====\nSELECT ticker, avg(((p >= 0.5)::INT = y)::INT) AS accuracy, sum((p >= 0.5)::INT * y) / nullif(sum((p >= 0.5)::INT), 0) AS precision, sum((p >= 0.5)::INT * y) / nullif(sum(y), 0) AS recall, 2 * sum((p >= 0.5)::INT * y) / nullif(sum((p >= 0.5)::INT) + sum(y), 0) AS f1, avg(pow(p - y, 2)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss FROM y GROUP BY 1", keys=("ticker",))
on_bars("e16_auc", lambda b: quality.auc(events(b).where("ret is not null").withColumn("y", (F.col("ret") > 0).cast("int")), "proba", "y"), [], ["auc"], f"{EVENTS}, {YP}, r AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY p) + (count(*) OVER (PARTITION BY ticker, p) - 1) / 2.0::DOUBLE AS k FROM y)\n====\nSELECT ticker, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1".replace("r AS (SELECT *, rank", "q AS (SELECT *, rank").replace("FROM r GROUP BY 1", "FROM q GROUP BY 1"), keys=("ticker",))


# simulations
def signals(b: DataFrame) -> DataFrame:
    """Events with signals, at prices that move by a few percent a day."""
    tame = {c: 1000 + F.col(c) / 10000 for c in ("open", "low", "close")}
    return events(b).withColumns(tame).withColumn("signal", F.when(F.col("proba") >= 0.75, 1.0).when(F.col("proba") <= 0.45, -1.0).otherwise(0.0))


ACCOUNT = f"""RECURSIVE r AS (SELECT *, {pct('close')} AS r FROM bars), z AS (SELECT ticker, date, 1000 + close / 10000 AS close, row_number() OVER ({W}) AS n, CASE WHEN {PROBA} >= 0.75 THEN 1 WHEN {PROBA} <= 0.45 THEN -1 ELSE 0 END AS s FROM r),
  f AS (SELECT ticker, date, n, close,
      CASE WHEN s > 0 THEN CAST(floor(1e7 / (close * 1.001)) AS BIGINT) ELSE 0 END AS shares,
      CASE WHEN s > 0 THEN 1e7 - floor(1e7 / (close * 1.001)) * close - floor(1e7 / (close * 1.001)) * close * 0.001 ELSE 1e7 END::DOUBLE AS cash,
      (s > 0)::INT::BIGINT AS buys, 0::BIGINT AS sells FROM z WHERE n = 1
    UNION ALL SELECT z.ticker, z.date, z.n, z.close,
      CASE WHEN s > 0 AND shares = 0 THEN CAST(floor(cash / (z.close * 1.001)) AS BIGINT) WHEN s < 0 THEN 0 ELSE shares END,
      CASE WHEN s > 0 AND shares = 0 THEN cash - floor(cash / (z.close * 1.001)) * z.close - floor(cash / (z.close * 1.001)) * z.close * 0.001 WHEN s < 0 AND shares > 0 THEN cash + shares * z.close - shares * z.close * 0.001 ELSE cash END,
      buys + (s > 0 AND shares = 0 AND floor(cash / (z.close * 1.001)) > 0)::INT, sells + (s < 0 AND shares > 0)::INT
    FROM f JOIN z ON z.ticker = f.ticker AND z.n = f.n + 1)
====
SELECT ticker, date, shares, buys, sells, cash + shares * close AS balance FROM f"""
on_bars("e3_single_pass", lambda b: simulation.simulate(signals(b)), ["shares", "buys", "sells"], ["balance"], ACCOUNT, 3)
on_bars("e4_continuous_allocation", lambda b: simulation.simulate(signals(b), "continuous_allocation"), ["shares", "buys", "sells"], ["balance"], None, 3)
on_bars("e5_probabilistic", lambda b: simulation.simulate(signals(b), "probabilistic"), ["shares", "buys", "sells"], ["balance"], None, 3)
on_bars("e6_optimise", lambda b: simulation.optimise(signals(b), "continuous_allocation", {"share": [0.1 * k for k in range(1, 11)], "stop": [0.01 * k for k in range(1, 10)]}, "sharpe"), [], ["share", "stop", "total", "sharpe"], None, keys=("ticker",))


# models
FEATURES = ["ret_1", "ret_5", "roc", "stoch_k"]


def samples(b: DataFrame) -> DataFrame:
    b = price.stochastic(price.rate_of_change(price.returns(b, (1, 5))))
    return labels.binary_target(b, 5, 0.0, True).withColumnRenamed("target", "y").select("ticker", "date", "close", "y", "fwd", *FEATURES)


on_bars("e1_forest", lambda b: learning.predict(learning.fit(samples(b).where("date < '1999-01-01'"), FEATURES), samples(b).where("date >= '1999-01-01'")), ["y"], ["proba"], None)
on_bars("e2_walk_forward", lambda b: learning.fold_summary(learning.walk_forward(samples(b), FEATURES)), ["fold"], ["accuracy", "mean", "std"], None, keys=())
on_bars("e7_permutation_target_test", lambda b: learning.permutation_target_test(samples(b), FEATURES, 1), ["seed"], ["auc"], None, keys=())
on_bars("e8_permutation_importance", lambda b: learning.permutation_importance(learning.fit(samples(b), FEATURES, "logistic"), samples(b), FEATURES), ["feature"], ["importance"], None, keys=())
on_bars("e9_feature_stability", lambda b: learning.feature_stability(samples(b), FEATURES, 2), ["feature", "stable"], ["mean", "cv"], None, keys=())
on_bars("e10_regime_validation", lambda b: learning.regime_validation(learning.walk_forward(samples(b), FEATURES, 2), b.withColumn("_r", spark_pct("close")).withColumn("regime", F.when(spark_roll(F.stddev_samp, "_r", 20) > 0.5, 1).otherwise(0)).select("ticker", "date", "regime"), quality.next_returns(b).select("ticker", "date", "next_ret")), ["regime", "n"], ["sharpe"], None, keys=())
on_bars("e11_e18_selected_boosting", lambda b: learning.predict(learning.fit(samples(b), FEATURES, "boosted", 2), samples(b)), ["y"], ["proba"], None)
on_bars("e13_random_search", lambda b: learning.random_search(samples(b), FEATURES, 2), ["trial", "parameters", "features"], ["score"], None, keys=())
on_bars("e15_calibration", lambda b: (lambda s: learning.calibrate(s.where("date < '1999-01-01'"), s.where("date >= '1999-01-01'")))(learning.walk_forward(samples(b), FEATURES, 2)), ["y"], ["proba", "calibrated"], None)
on_bars("e17_linear", lambda b: learning.linear(samples(b).where("date < '1999-01-01'"), samples(b).where("date >= '1999-01-01'"), FEATURES, "fwd"), [], ["prediction"], None)

# events as bars
add("a1_event_bars", lambda s, d: align.window_bars(table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")), ["ticker", "start", "n"], ["high", "low", "total"], "\n====\nSELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMPTZ) AS start, count(*) AS n, max(value) AS high, min(value) AS low, sum(value) AS total FROM events GROUP BY 1, 2", 4)
SQL["a1_event_bars"] = SQL["a1_event_bars"].replace("CAST(date_trunc('hour', ts) AS TIMESTAMPTZ)", "date_trunc('hour', ts)")


def _stream(f):
    return lambda s, d: streams.run_to_table(f(streams.read_events(s, streams.staged(table(s, d, "events")), 1)))


CLOSED = "\n====\nSELECT event_type AS ticker, date_trunc('hour', ts) AS start, count(*) AS n, max(value) AS high, min(value) AS low, sum(value) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
add("stream_event_bars", _stream(streams.stream_bars), ["ticker", "start", "n"], ["high", "low", "total"], CLOSED, 4)
EMA = f"e AS (SELECT event_type, ts, value, list_reduce(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda y, x: {1 - 2 / 13!r} * y + {2 / 13!r} * x) AS ema FROM events)\n====\nSELECT * FROM e"
add("stream_averages", _stream(streams.stream_averages), ["event_type", "ts"], ["value", "ema"], EMA)
