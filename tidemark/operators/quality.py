"""Profiles, health reports, scores and stability of data sets, and metrics of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import ahead, div, ordered, pct, prev
from .labels import forward_return


def null_share(df: DataFrame, columns: list[str]) -> Column:
    return sum((F.avg(F.col(c).isNull().cast("double")) for c in columns[1:]), F.avg(F.col(columns[0]).isNull().cast("double"))) / len(columns)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ticker (data set): rows, days twice, median gap, NULLs, sparse and near-constant columns, longest staleness."""
    w = ordered()
    df = df.withColumns({f"_r_{c}": F.when(F.col(c) == prev(c), 0).otherwise(1) for c in columns})
    df = df.withColumns({f"_r_{c}": F.sum(f"_r_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    df = df.withColumns({f"_s_{c}": F.row_number().over(Window.partitionBy("ticker", f"_r_{c}").orderBy("date")) - 1 for c in columns} | {"_gap": F.datediff("date", prev("date"))})
    stale = F.greatest(*[F.max(f"_s_{c}") for c in columns]) if len(columns) > 1 else F.max(f"_s_{columns[0]}")
    return df.groupBy(F.col("ticker").alias("dataset")).agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("date")).alias("dup_index_rows"),
        F.floor(F.percentile("_gap", 0.5)).cast("double").alias("median_gap_days"),
        null_share(df, columns).alias("nan_overall"),
        sum((F.when(F.avg(F.col(c).isNull().cast("double")) > 0.8, 1).otherwise(0) for c in columns), F.lit(0)).alias("n_sparse_cols"),
        sum((F.when(F.var_pop(c) < 1e-10, 1).otherwise(0) for c in columns), F.lit(0)).alias("n_near_constant"),
        stale.cast("int").alias("worst_staleness"),
    )


def identical_columns(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(a, b): pairs of columns equal in every row, NULLs alike: candidates by a sum of hashes, then verified, all rows in two passes."""
    hashes = df.agg(*[F.sum(F.xxhash64(*key, F.col(c).cast("string")).cast("decimal(38,0)")).alias(c) for c in columns]).first()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if hashes[a] == hashes[b]]
    schema = "a string, b string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    row = df.agg(*[F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return df.sparkSession.createDataFrame([p for i, p in enumerate(pairs) if row[f"p{i}"] == 1], schema)


def index_stats(df: DataFrame) -> DataFrame:
    gap = df.withColumn("_g", F.datediff("date", prev("date")))
    return gap.groupBy("ticker").agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("date")).alias("dups"), F.min("date").alias("first"), F.max("date").alias("last"), F.percentile("_g", 0.5).alias("median_gap"))


def target_health(df: DataFrame, windows: list[int], thresholds: list[float], least: int = 100) -> DataFrame:
    """Per ticker, window and threshold: samples, rates, quantiles of the forward return, mean run lengths and issues."""
    long = None
    for w in windows:
        x = df.select("ticker", "date", F.lit(w).alias("horizon"), forward_return(w).alias("fwd"))
        long = x if long is None else long.unionByName(x)
    grid = F.explode(F.array(*map(F.lit, thresholds)))
    x = long.where("fwd is not null").withColumn("threshold", grid).withColumn("y", (F.col("fwd") > F.col("threshold")).cast("int"))
    key = ["ticker", "horizon", "threshold"]
    w = Window.partitionBy(*key).orderBy("date")
    x = x.withColumn("_new", F.when(F.col("y") == F.lag("y").over(w), 0).otherwise(1))
    years = x.groupBy(*key, F.year("date").alias("year")).agg(F.avg("y").alias("rate"))
    years = years.groupBy(*key).agg((F.max("rate") - F.min("rate")).alias("drift"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", F.round("rate", 3).alias("rate"))))).alias("pos_rate_by_year"))
    a = x.groupBy(*key).agg(
        F.count("*").alias("eff_samples"),
        F.avg("y").alias("pos_rate"),
        F.sum("y").alias("pos_count"),
        F.percentile("fwd", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("_q"),
        div(F.sum("y").cast("double"), F.sum(F.when(F.col("y") == 1, F.col("_new")))).alias("mean_run_up"),
        div(F.sum(1 - F.col("y")).cast("double"), F.sum(F.when(F.col("y") == 0, F.col("_new")))).alias("mean_run_down"),
    )
    j = a.join(years, key)
    issues = F.array_join(F.array_compact(F.array(F.when((F.col("pos_rate") < 0.05) | (F.col("pos_rate") > 0.95), "extreme_imbalance"), F.when(F.col("drift") > 0.25, "base_rate_drift"), F.when(F.col("eff_samples") < least, "insufficient_samples"))), ";")
    return j.select(*key, "eff_samples", "pos_rate", "pos_count", (F.col("eff_samples") - F.col("pos_count")).alias("neg_count"), F.col("_q")[0].alias("median_ret"), F.col("_q")[1].alias("q10"), F.col("_q")[2].alias("q90"), "mean_run_up", "mean_run_down", "drift", "pos_rate_by_year", issues.alias("issues"))


def suggested_thresholds(df: DataFrame, n: int, rate: float) -> DataFrame:
    return df.withColumn("fwd", forward_return(n)).groupBy("ticker").agg(F.round(F.percentile("fwd", 1 - rate), 6).alias("threshold"))


def scores(df: DataFrame, features: list[str], y: str, least: int = 150, top: int = 5) -> DataFrame:
    """Per ticker the mean absolute correlation of its ``top`` best features with a label, and their names."""
    long = df.unpivot(["ticker", y], features, "feature", "x")
    both = F.when(F.col("x").isNotNull() & F.col(y).isNotNull(), 1)
    c = long.groupBy("ticker", "feature").agg(F.abs(F.corr("x", F.col(y).cast("double"))).alias("score"), F.count(both).alias("n")).where((F.col("n") >= least) & F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy("ticker").orderBy(F.desc("score"), "feature")
    best = c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    return best.groupBy("ticker").agg(F.avg("score").alias("score"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "feature"))), lambda s: s["feature"]), ",").alias("top_features"))


def ic_series(df: DataFrame, features: list[str], ret: str, n: int = 60) -> DataFrame:
    """(ticker, date, feature, ic): rolling correlation of each feature with a return."""
    long = df.unpivot(["ticker", "date", ret], features, "feature", "x")
    w = Window.partitionBy("ticker", "feature").orderBy("date").rowsBetween(-(n - 1), 0)
    both = F.when(F.col("x").isNotNull() & F.col(ret).isNotNull(), 1)
    return long.select("ticker", "date", "feature", F.when(F.count(both).over(w) >= n, F.corr("x", ret).over(w)).alias("ic"))


def rank_ic_series(df: DataFrame, x: str, y: str, n: int = 20) -> DataFrame:
    """(ticker, date, ic): within each window of n rows the correlation of average ranks.  The frame is bounded, and ranks are counted in it."""
    w = ordered().rowsBetween(-(n - 1), 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    df = df.withColumns({"_xs": F.collect_list(F.when(both, F.col(x))).over(w), "_ys": F.collect_list(F.when(both, F.col(y))).over(w)})

    def ranks(c: str) -> Column:
        v = F.col(c)
        return F.transform(v, lambda a: (F.size(F.filter(v, lambda b: b < a)) + (F.size(F.filter(v, lambda b: b == a)) + 1) / 2).cast("double"))

    zero = F.lit(0.0)
    df = df.withColumns({"_rx": ranks("_xs"), "_ry": ranks("_ys")})
    m = (n + 1) / 2
    cov = F.aggregate(F.zip_with("_rx", "_ry", lambda a, b: (a - m) * (b - m)), zero, lambda s, v: s + v)
    vx = F.aggregate(F.transform("_rx", lambda a: (a - m) * (a - m)), zero, lambda s, v: s + v)
    vy = F.aggregate(F.transform("_ry", lambda a: (a - m) * (a - m)), zero, lambda s, v: s + v)
    return df.select("ticker", "date", F.when(F.size("_xs") >= n, div(cov, F.sqrt(vx * vy))).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    q = F.percentile("ic", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = ic.groupBy("ticker", "feature").agg(q.alias("q"), F.avg(F.coalesce((F.col("ic") > 0).cast("double"), F.lit(0.0))).alias("positive"), F.stddev_samp("ic").alias("sd"))
    return a.select("ticker", "feature", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "positive", (F.col("q")[1] / (F.col("sd") + 1e-12) * 252**0.5).alias("ir"))


def topk_turnover(df: DataFrame, score: str, k: int) -> DataFrame:
    """(date, turnover): of the k best tickers of a date, the share that were not among those of the date before that had any."""
    w = Window.partitionBy("date").orderBy(F.desc(score), "ticker")
    best = df.where(F.col(score).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    sets = best.groupBy("date").agg(F.collect_set("ticker").alias("s"))
    # one row per date: the dates of all years fit one task
    x = sets.withColumn("p", F.lag("s").over(Window.orderBy("date")))
    return x.where("p is not null").select("date", (1 - F.size(F.array_intersect("s", "p")) / (F.size("p") + 1e-9)).alias("turnover"))


def returns_of(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "date", "close", pct("close").alias("ret"))


def sharpe(df: DataFrame, c: str) -> Column:
    return F.coalesce(div(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))) * 252**0.5, F.lit(0.0))


def net_of_costs(df: DataFrame, ret: str, cost: float) -> DataFrame:
    """Returns less the cost of going in or out; a position is held where the return is not zero."""
    df = df.withColumn("_h", (F.coalesce(F.col(ret), F.lit(0.0)) != 0).cast("int"))
    return df.withColumn("net", F.col(ret) - cost * F.coalesce(F.abs(F.col("_h") - prev("_h")), F.lit(0))).drop("_h")


def max_drawdown(df: DataFrame, ret: str) -> DataFrame:
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_e", F.exp(F.sum(F.ln(1 + F.coalesce(F.col(ret), F.lit(0.0)))).over(w)))
    return df.withColumn("_p", F.max("_e").over(w)).groupBy("ticker").agg(F.max(1 - F.col("_e") / F.col("_p")).alias("max_drawdown"))


def return_metrics(df: DataFrame, value: str) -> DataFrame:
    a = df.groupBy("ticker").agg(F.min_by(value, "date").alias("start"), F.max_by(value, "date").alias("end"), F.count("*").alias("days"))
    total = F.col("end") / F.col("start") - 1
    return a.withColumns({"total": total, "annual": F.pow(1 + total, 252 / F.col("days")) - 1})


def buy_and_hold(df: DataFrame, cash: float) -> DataFrame:
    first = F.first("close").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    shares = F.floor(F.lit(cash) / first).cast("double")
    return df.withColumn("equity", shares * F.col("close") + (F.lit(cash) - shares * first))


def decision_metrics(df: DataFrame) -> DataFrame:
    """Trades, exposure, hit rate and PnL of rows with a signal and a PnL."""
    trades = F.count(F.when(F.col("signal") != 0, 1))
    return df.groupBy("ticker").agg(trades.alias("trades"), (trades / F.count("*")).alias("exposure"), div(F.count(F.when(F.col("pnl") > 0, 1)).cast("double"), trades.cast("double")).alias("hit_rate"), F.sum("pnl").alias("pnl"))


def classification_metrics(df: DataFrame, p: str, y: str) -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score and log loss per ticker."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    hit = (F.col(p) >= 0.5).cast("int")
    a = df.groupBy("ticker").agg(
        F.avg((hit == F.col(y)).cast("double")).alias("accuracy"),
        F.sum(hit * F.col(y)).cast("double").alias("_tp"), F.sum(hit).cast("double").alias("_p"), F.sum(y).cast("double").alias("_y"),
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"),
        F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"),
    )
    return a.select("ticker", "accuracy", div("_tp", "_p").alias("precision"), div("_tp", "_y").alias("recall"), div(2 * F.col("_tp"), F.col("_p") + F.col("_y")).alias("f1"), "brier", "log_loss")


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties by average rank."""
    g = df.groupBy("ticker", p).agg(F.count("*").alias("n"), F.sum(y).alias("k"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ticker").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.withColumn("rank", before + (F.col("n") + 1) / 2)
    a = r.groupBy("ticker").agg(F.sum(F.col("rank") * F.col("k")).alias("s"), F.sum("k").alias("pos"), F.sum(F.col("n") - F.col("k")).alias("neg"))
    return a.select("ticker", div(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, (F.col("pos") * F.col("neg")).cast("double")).alias("auc"))


def content_hash(df: DataFrame) -> DataFrame:
    """Rows and a hash of all cells that doesn't depend on their order."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same): whether two tables have the same rows, in any order, by their hashes."""
    x, y = content_hash(a), content_hash(b)
    return x.join(F.broadcast(y.withColumnsRenamed({"rows": "r", "hash": "h"})), F.col("rows").eqNullSafe(F.col("r")), "left").select(F.col("h").eqNullSafe(F.col("hash")).alias("same"))


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def next_returns(bars: DataFrame) -> DataFrame:
    return returns_of(bars).withColumn("next_ret", ahead("ret"))
