"""Queries of whole pipelines: sector data sets, triage of data sets, labels to decisions (C, A18, E12 to E14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.exprs import ahead, pct
from ..operators import align, labels, learning, price, quality, simulation, transforms
from ..sources.views import LAGS, bars, macro_monthly
from .catalog import add

FEATURES = ["ret_1", "ret_5", "vol_20", "rsi_14", "roc", "stoch_k", "discount", "tax"]
SCALED = ["ret_1", "rsi_14", "discount"]


def sector_dataset(b: DataFrame, macro: DataFrame) -> DataFrame:
    """Features of all tickers, macro series as they were published, warm-up and sparse rows dropped, features winsorized, imputed and standardised; prices stay as they are."""
    rows = align.asof_lagged(price.base_features(b), macro, {k: LAGS[k] for k in ("discount", "tax")}, 31)
    rows = transforms.drop_rows(transforms.after_warm_up(rows, 60), 0.5, FEATURES)
    return transforms.chain(rows.select("ticker", "date", "close", *SCALED), SCALED)


def triage(b: DataFrame, rows: int = 750, window: int = 5) -> DataFrame:
    """Data sets ranked by the mean of their best correlations with the target over their last rows."""
    x = labels.binary_target(price.stochastic(price.rate_of_change(price.returns(b, (1, 5)))), window, 0.0)
    s = quality.scores(transforms.tail(x, rows), ["ret_1", "ret_5", "roc", "stoch_k"], "target", 30, 5)
    return s.orderBy(F.desc_nulls_last("score"), "ticker").limit(30)


def meta_samples(b: DataFrame, horizon: int = 5) -> DataFrame:
    """Bars with features and, where a base rule has a side, its meta-label ``y``."""
    x = price.stochastic(price.rate_of_change(price.returns(b, (1, 5))))
    m = labels.meta_labels(b, horizon, 1.0, 1.0, 3, 10).select("ticker", F.col("t").alias("date"), "t1", "side", "y")
    return x.join(m, ["ticker", "date"])


def meta_decisions(b: DataFrame, folds: int = 3) -> DataFrame:
    """Out-of-sample probabilities of the meta-labels, a threshold per ticker and fold, and the daily PnL of what they decide.

    A fold's threshold is chosen on the folds before it, whose rows its model has not
    been tested on; the first fold has none and takes 0.5.
    """
    samples = meta_samples(b)
    scored = learning.walk_forward(samples, ["ret_1", "ret_5", "roc", "stoch_k"], folds)
    following = b.withColumn("_r", pct("close")).withColumn("ret", ahead("_r")).select("ticker", "date", "ret")
    events = scored.join(samples.select("ticker", "date", "side"), ["ticker", "date"]).join(following, ["ticker", "date"])
    chosen = []
    for k in range(1, folds):
        before = events.where(F.col("fold") < k).select("ticker", "date", "proba", "side", "ret")
        chosen.append(labels.threshold_with_trades(before, labels.best_threshold(before)).withColumn("fold", F.lit(k)))
    decided = events.join(reduce(DataFrame.unionByName, chosen), ["ticker", "fold"], "left")
    decided = decided.withColumn("signal", F.when(F.col("proba") >= F.coalesce("threshold", F.lit(0.5)), F.col("side")).otherwise(0.0))
    return quality.decision_metrics(labels.daily_pnl(b, decided.select("ticker", "date", "signal")))


#: Parameters of the account within a fold: twenty shares of the equity by ten stops.
ACCOUNTS = {"share": [0.05 * k for k in range(1, 21)], "stop": [0.01 * k for k in range(1, 11)]}


def walk_forward_backtest(rows: DataFrame, features: list[str], folds: int = 3, grid: dict[str, list[float]] | None = None, cash: float = 10_000_000.0, **args) -> DataFrame:
    """(ticker, fold, date, the grid's columns, balance, equity): per expanding fold a model, its signals on the
    test rows, the account parameters of the best total return there, and the equity of all folds one after the other.

    ``rows`` have prices, features and ``y``. The best point is chosen on the rows it is shown on, so
    equity is what the grid can reach and no estimate of what it will.
    """
    grid = grid or ACCOUNTS
    scored = learning.walk_forward(rows, features, folds).select("ticker", "date", F.col("fold").cast("double").alias("fold"), F.when(F.col("proba") >= 0.5, 1.0).otherwise(-1.0).alias("signal"))
    traded = rows.select("ticker", "date", "open", "low", "close").join(scored, ["ticker", "date"])
    best = simulation.optimise(traded, "continuous_allocation", grid, within=("fold",), cash=cash, **args)
    # the chosen accounts again: one of the grid's points, for less than keeping the days of all
    shown = simulation.simulate(traded.join(best.select("ticker", "fold", *grid), ["ticker", "fold"]), "continuous_allocation", grid=["fold", *grid], cash=cash, **args)
    grown = shown.groupBy("ticker", "fold").agg((F.max_by("balance", "date") / cash).alias("grown"))
    before = Window.partitionBy("ticker").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    start = grown.select("ticker", "fold", F.coalesce(F.product("grown").over(before), F.lit(1.0)).alias("_start"))
    out = shown.join(start, ["ticker", "fold"]).withColumn("equity", F.col("balance") * F.col("_start"))
    return out.select("ticker", F.col("fold").cast("int").alias("fold"), "date", *grid, "balance", "equity")


def _tame(b: DataFrame) -> DataFrame:
    """Features and ``y``, and prices that move by a few percent a day."""
    x = labels.binary_target(price.stochastic(price.rate_of_change(price.returns(b, (1, 5)))), 5, 0.0, True).withColumnRenamed("target", "y")
    return x.withColumns({c: 1000 + F.col(c) / 10000 for c in ("open", "low", "close")})


def _bars(f):
    return lambda s, d: f(bars(s, d))


def _sector(s: SparkSession, d: str) -> DataFrame:
    return sector_dataset(bars(s, d), macro_monthly(s, d))


add("c4_c5_sector_dataset", _sector, ["ticker", "date"], ["close", *SCALED], None, 4)
add("c6_k4_triage", _bars(triage), ["ticker", "top_features"], ["score"], None)
add("e12_e14_meta_decisions", _bars(meta_decisions), ["ticker", "trades"], ["exposure", "hit_rate", "pnl"], None)
add("c3_stock_features", _bars(lambda b: price.stock_features(b, "none", "1-URGENT", ("2-HIGH", None))), ["ticker", "date"], ["sector_strength", "sector_beta", "market_strength", "market_beta", "rsi_14", "macd"], None)
add("e2_walk_forward_backtest", _bars(lambda b: walk_forward_backtest(_tame(b), ["ret_1", "ret_5", "roc", "stoch_k"])), ["ticker", "fold", "date"], ["share", "stop", "balance", "equity"], None, 3)
add("e17_e18_coarse_grid", _bars(lambda b: learning.coarse_grid(_tame(b), ["ret_1", "ret_5", "roc", "stoch_k"], {"y": 2}, ["fwd"], 1)), ["target", "features", "model"], ["score"], None)
