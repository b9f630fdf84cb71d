"""Targets, triple barriers, meta-labels, time-aware splits and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import ahead, div, ordered, prev, roll
from ..functions.recursive import EwmStd, recursive


def forward_return(n: int):
    return div(ahead("close", n), "close") - 1


def binary_target(df: DataFrame, n: int, threshold: float, drop_incomplete: bool = False) -> DataFrame:
    """1 if the forward return is over the threshold, else 0; rows without one are 0, or are dropped."""
    df = df.withColumn("fwd", forward_return(n))
    df = df.where("fwd is not null") if drop_incomplete else df
    return df.withColumn("target", F.coalesce((F.col("fwd") > threshold).cast("int"), F.lit(0)))


def class_target(df: DataFrame, n: int, threshold: float, extreme: float | None = None) -> DataFrame:
    """1, 0, -1 for up, flat, down; with ``extreme`` 3, 2, 1, 0, 4 for far up, up, flat, down, far down.  Without a forward return: -1, with ``extreme`` 2."""
    f = F.col("fwd")
    df = df.withColumn("fwd", forward_return(n))
    if extreme is None:
        return df.withColumn("target", F.when(f > threshold, 1).when(f >= -threshold, 0).otherwise(-1))
    rule = F.when(f <= -extreme, 4).when(f >= extreme, 3).when(f < -threshold, 0).when(f.between(-threshold, threshold), 1)
    return df.withColumn("target", rule.otherwise(2))


def daily_volatility(df: DataFrame, span: int = 20) -> DataFrame:
    """``vol``: exponentially weighted deviation of log returns."""
    df = df.withColumn("_lr", F.ln(div("close", prev("close"))))
    return recursive(df, [("vol", "_lr", lambda: EwmStd(span, span))]).drop("_lr")


def vertical_barriers(df: DataFrame, horizon: int) -> DataFrame:
    """``t1``: the date ``horizon`` rows on, or the last one."""
    return df.withColumn("t1", F.coalesce(ahead("date", horizon), F.max("date").over(Window.partitionBy("ticker"))))


def triple_barrier(events: DataFrame, horizon: int, up: float, down: float) -> DataFrame:
    """``events(ticker, date, close, trgt, side)``, one row per bar -> t1, ret, type, bin for bars with a target and a later bar.

    The log path of the next ``horizon`` closes, times the side, first at
    or over ``up`` targets is ``pt``, at or under ``-down`` targets ``sl`` (which wins if both
    hold), and ``tl`` at the last bar if neither.  The frame is bounded, so no range join is needed.
    """
    w = ordered().rowsBetween(1, horizon)
    path = F.collect_list(F.struct("date", "close")).over(w)
    side = F.coalesce(F.col("side"), F.lit(1.0))
    df = events.withColumn("_p", path).where("trgt is not null and size(_p) > 0")
    steps = F.transform("_p", lambda x: F.struct(x["date"].alias("date"), (F.ln(x["close"] / F.col("close")) * side).alias("r")))
    df = df.withColumn("_s", steps)
    hits = F.filter("_s", lambda x: (x["r"] >= up * F.col("trgt")) | (x["r"] <= -down * F.col("trgt")))
    df = df.withColumn("_h", F.coalesce(F.get(hits, F.lit(0)), F.element_at("_s", -1))).withColumn("_hit", F.size(hits) > 0)
    r = F.col("_h.r")
    kind = F.when(~F.col("_hit"), "tl").when(r <= -down * F.col("trgt"), "sl").otherwise("pt")
    return df.select("ticker", F.col("date").alias("t"), F.col("_h.date").alias("t1"), r.alias("ret"), kind.alias("type"), F.when(F.abs(r) < 1e-12, 0).otherwise(F.signum(r)).cast("int").alias("bin"), "trgt", "side")


def primary_labels(bars: DataFrame, horizon: int, up: float, down: float, least: float, span: int = 20) -> DataFrame:
    """Triple barriers at the daily volatility, of bars whose volatility is over ``least``."""
    v = daily_volatility(bars, span)
    return triple_barrier(v.withColumn("trgt", F.when(F.col("vol") > least, F.col("vol"))).withColumn("side", F.lit(None).cast("double")), horizon, up, down)


def ma_cross(df: DataFrame, fast: int, slow: int) -> DataFrame:
    """``side``: 1 or -1 on the bar where the fast mean crosses the slow one, else 0."""
    df = df.withColumn("_d", F.signum(roll(F.avg, "close", fast) - roll(F.avg, "close", slow)))
    before = prev("_d")
    return df.withColumn("side", F.when((F.col("_d") > 0) & (before <= 0), 1.0).when((F.col("_d") < 0) & (before >= 0), -1.0).otherwise(0.0)).drop("_d")


def meta_labels(bars: DataFrame, horizon: int, up: float, down: float, fast: int = 5, slow: int = 20) -> DataFrame:
    """Triple barriers of the bars where a base rule has a side; y is 1 if following it paid."""
    v = daily_volatility(ma_cross(bars, fast, slow))
    rows = triple_barrier(v.withColumn("trgt", F.when(F.col("side") != 0, F.col("vol"))), horizon, up, down)
    return rows.withColumn("y", (F.col("ret") > 0).cast("int"))


def event_weights(df: DataFrame, c: str = "trgt", power: float = 1.0) -> DataFrame:
    x = F.pow(F.abs(F.col(c)), power)
    return df.withColumn("weight", x / F.avg(x).over(Window.partitionBy("ticker")))


def class_weights(df: DataFrame, y: str = "y", weight: str = "weight") -> DataFrame:
    """Event weights, those of class 1 times (others / ones)."""
    w = Window.partitionBy("ticker")
    pos, neg = F.count(F.when(F.col(y) == 1, 1)).over(w), F.count(F.when(F.col(y) != 1, 1)).over(w)
    return df.withColumn("class_weight", F.col(weight) * F.when(F.col(y) == 1, neg / F.greatest(pos, F.lit(1))).otherwise(1.0))


def decide(df: DataFrame, least: float) -> DataFrame:
    return df.withColumn("signal", F.when(F.col("proba") >= least, F.col("side")).otherwise(0.0))


def best_threshold(events: DataFrame, cost: float = 0.0005) -> DataFrame:
    """(ticker, threshold): of 0.50, 0.525, ... 0.70 the one with the best Sharpe ratio after costs over events (date, proba, side, ret); the lowest of equals."""
    grid = events.sparkSession.range(9).select((F.lit(0.5) + F.col("id") * 0.025).alias("threshold"))
    rows = events.join(F.broadcast(grid)).withColumn("pnl", F.when(F.col("proba") >= F.col("threshold"), F.col("side") * F.col("ret")).otherwise(0.0))
    w = Window.partitionBy("ticker", "threshold").orderBy("date")
    held = (F.col("pnl") != 0).cast("int")
    rows = rows.withColumn("net", F.col("pnl") - cost * F.coalesce(F.abs(held - F.lag(held).over(w)), F.lit(0)))
    s = rows.groupBy("ticker", "threshold").agg(F.coalesce(div(F.avg("net"), F.stddev_samp("net")) * 252**0.5, F.lit(0.0)).alias("sharpe"))
    return s.groupBy("ticker").agg(F.max_by("threshold", F.struct("sharpe", -F.col("threshold"))).alias("threshold"), F.max("sharpe").alias("sharpe"))


def threshold_with_trades(events: DataFrame, best: DataFrame, least: int = 5, default: float = 0.5) -> DataFrame:
    """(ticker, threshold): the best threshold (``default`` where there is none) if at least ``least`` events reach it, else the first of falling quantiles of the probabilities that so many reach."""
    steps = [0.98, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55]
    quantiles = events.groupBy("ticker").agg(F.percentile("proba", F.array(*map(F.lit, steps))).alias("q"))
    start = quantiles.join(best.select("ticker", "threshold"), "ticker", "left").withColumn("start", F.coalesce("threshold", F.lit(default)))
    tried = start.select("ticker", "start", F.posexplode(F.concat(F.array("start"), "q")).alias("at", "cut"))
    reached = events.select("ticker", "proba").join(tried, "ticker").groupBy("ticker", "at", "cut", "start").agg(F.count(F.when(F.col("proba") >= F.col("cut"), 1)).alias("n"))
    first = F.min_by("cut", F.when(F.col("n") >= least, F.col("at")))
    return reached.groupBy("ticker").agg(F.coalesce(first, F.first("start")).alias("threshold"))


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({"pos": F.row_number().over(ordered()) - 1, "n": F.count("*").over(Window.partitionBy("ticker"))})


def purged_splits(events: DataFrame, folds: int, test: int | None = None) -> DataFrame:
    """(ticker, fold, role, date): the last ``folds`` blocks of ``test`` rows are tested in order; train rows lie before and end (t1) before the block."""
    rows = numbered(events)
    size = F.lit(test) if test else F.greatest(F.lit(32), F.floor(F.col("n") * 0.2)).cast("int")
    rows = rows.withColumn("size", size)
    grid = events.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    x = rows.join(F.broadcast(grid)).withColumn("lo", F.col("n") - (folds - F.col("fold")) * F.col("size"))
    w = Window.partitionBy("ticker", "fold")
    x = x.withColumn("start", F.min(F.when(F.col("pos") == F.col("lo"), F.col("date"))).over(w)).where("lo > 0")
    role = F.when((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("lo") + F.col("size")), "test").when((F.col("pos") < F.col("lo")) & (F.col("t1") < F.col("start")), "train")
    return x.withColumn("role", role).where("role is not null").select("ticker", "fold", "role", "date")


def block_splits(df: DataFrame, folds: int, purge: int, embargo: int) -> DataFrame:
    """(ticker, fold, role, date): contiguous blocks, the last with the remainder; train rows keep ``purge`` before and ``embargo`` after their distance."""
    rows = numbered(df).withColumn("size", F.floor(F.col("n") / folds).cast("int"))
    grid = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    x = rows.join(F.broadcast(grid)).withColumns({"lo": F.col("fold") * F.col("size"), "hi": F.when(F.col("fold") == folds - 1, F.col("n")).otherwise((F.col("fold") + 1) * F.col("size"))})
    role = F.when((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")), "test").when((F.col("pos") < F.col("lo") - purge) | (F.col("pos") >= F.col("hi") + embargo), "train")
    return x.withColumn("role", role).where("role is not null").select("ticker", "fold", "role", "date")


def expanding_splits(df: DataFrame, folds: int, gap: int = 0) -> DataFrame:
    """(ticker, fold, role, date): equal test blocks at the end, all rows before (less ``gap``) train."""
    rows = numbered(df).withColumn("size", F.floor(F.col("n") / (folds + 1)).cast("int"))
    grid = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    x = rows.join(F.broadcast(grid)).withColumn("lo", F.col("n") - (folds - F.col("fold")) * F.col("size"))
    role = F.when((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("lo") + F.col("size")), "test").when(F.col("pos") < F.col("lo") - gap, "train")
    return x.withColumn("role", role).where("role is not null").select("ticker", "fold", "role", "date")


def split_dates(events: DataFrame, train: float = 0.75, valid: float = 0.15) -> DataFrame:
    """(ticker, train_end, valid_end): dates at those shares of the events."""
    rows = numbered(events)
    at = lambda f: F.max(F.when(F.col("pos") == F.greatest(F.floor(F.lit(f) * F.col("n")) - 1, F.lit(0)), F.col("date")))
    return rows.groupBy("ticker").agg(at(train).alias("train_end"), at(train + valid).alias("valid_end"))


def daily_pnl(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of some days on all days, 0 elsewhere, times the next day's return."""
    df = bars.withColumn("ret", div("close", prev("close")) - 1).withColumn("next_ret", ahead("ret"))
    j = df.join(signals, ["ticker", "date"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    return j.select("ticker", "date", "signal", F.coalesce(F.col("signal") * F.col("next_ret"), F.lit(0.0)).alias("pnl"))
