"""Features of one ticker's bars: returns, ranges, trends, oscillators, volume, streaks."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import ahead, div, kurtosis_corrected, ordered, pct, prev, roll, running, skew_corrected
from ..functions.recursive import Ewm, LocalLevel, recursive

TINY = 1e-9


def returns(df: DataFrame, lags: tuple[int, ...] = (1,)) -> DataFrame:
    return df.withColumns({f"ret_{k}": pct("close", k) for k in lags})


def next_day_targets(df: DataFrame) -> DataFrame:
    df = returns(df)
    return df.withColumn("next_ret", ahead("ret_1"))


def lagged(df: DataFrame, columns: list[str], lags: tuple[int, ...]) -> DataFrame:
    """Lags of the columns that exist."""
    return df.withColumns({f"{c}_lag_{k}": prev(c, k) for c in columns if c in df.columns for k in lags})


def ranges(df: DataFrame) -> DataFrame:
    return df.withColumns({"high_low": F.col("high") - F.col("low"), "close_open": F.col("close") - F.col("open"), "close_place": F.coalesce(div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))})


def true_range() -> Column:
    """NULL on the first row."""
    before = prev("close")
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def volume_features(df: DataFrame, n: int = 20) -> DataFrame:
    mean = roll(F.avg, "volume", n, 1)
    return df.withColumns({"volume_change": pct("volume") * 100, "volume_mean": mean, "volume_ratio": div(F.col("volume"), mean)})


def on_balance_volume(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)) * F.col("volume")
    return df.withColumn("_step", step).withColumn("obv", running(F.sum, "_step")).drop("_step")


def moving_averages(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    return df.withColumns({f"sma_{n}": roll(F.avg, "close", n) for n in windows})


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = roll(F.avg, "close", n), roll(F.stddev_samp, "close", n)
    df = df.withColumns({"bb_mid": mid, "_sd": sd})
    upper, lower = F.col("bb_mid") + k * F.col("_sd"), F.col("bb_mid") - k * F.col("_sd")
    return df.withColumns({"bb_upper": upper, "bb_lower": lower, "bb_width": (upper - lower) / (F.col("bb_mid") + TINY), "bb_place": div(F.col("close") - lower, upper - lower)}).drop("_sd")


def stochastic(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    low, high = roll(F.min, "low", n), roll(F.max, "high", n)
    df = df.withColumn("stoch_k", div(F.col("close") - low, high - low) * 100)
    return df.withColumn("stoch_d", roll(F.avg, "stoch_k", d))


def calendar(df: DataFrame) -> DataFrame:
    return df.withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")})


def mean_convergence(df: DataFrame, n: int = 50) -> DataFrame:
    return df.withColumn("mean_convergence", F.col("close") / (roll(F.avg, "close", n) + 1e-6))


def rate_of_change(df: DataFrame, n: int = 12) -> DataFrame:
    return df.withColumn("roc", pct("close", n) * 100)


def money_flow(df: DataFrame, n: int = 14) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_t", typical).withColumn("_p", prev("_t"))
    flow = F.col("_t") * F.col("volume")
    df = df.withColumns({"_up": F.when(F.col("_t") > F.col("_p"), flow).otherwise(0.0), "_down": F.when(F.col("_t") < F.col("_p"), flow).otherwise(0.0)})
    return df.withColumn("mfi", 100 - 100 / (1 + div(roll(F.sum, "_up", n), roll(F.sum, "_down", n)))).drop("_t", "_p", "_up", "_down")


def chaikin(df: DataFrame, n: int = 21) -> DataFrame:
    place = div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    df = df.withColumn("_flow", place * F.col("volume"))
    return df.withColumn("cmf", div(roll(F.sum, "_flow", n), roll(F.sum, "volume", n))).drop("_flow")


def volume_shock(df: DataFrame, n: int = 60, short: int = 5) -> DataFrame:
    mean, sd = roll(F.avg, "volume", n), roll(F.stddev_samp, "volume", n)
    return df.withColumns({"volume_z": (F.col("volume") - mean) / (sd + TINY), "volume_short_ratio": div(roll(F.avg, "volume", short), mean)})


def drawdown(df: DataFrame, n: int = 252) -> DataFrame:
    return df.withColumn("drawdown", F.col("close") / (roll(F.max, "close", n) + TINY) - 1)


def days_since_change(df: DataFrame, c: str, out: str = "days_since_change") -> DataFrame:
    """Place, from 0, in the current run of equal values; every NULL begins a run."""
    changed = F.when(F.col(c) == prev(c), 0).otherwise(1)
    df = df.withColumn("_new", changed).withColumn("_run", running(F.sum, "_new"))
    return df.withColumn(out, F.row_number().over(ordered(["ticker", "_run"])) - 1).drop("_new", "_run")


def streaks(df: DataFrame) -> DataFrame:
    """Lengths of the current runs of rising and falling closes."""
    sign = F.coalesce(F.signum(F.col("close") - prev("close")), F.lit(0.0)).cast("int")
    df = df.withColumn("_s", sign).withColumn("_new", F.when(F.col("_s") == prev("_s"), 0).otherwise(1)).withColumn("_run", running(F.sum, "_new"))
    place = F.row_number().over(ordered(["ticker", "_run"]))
    return df.withColumns({"up_streak": F.when(F.col("_s") > 0, place).otherwise(0), "down_streak": F.when(F.col("_s") < 0, place).otherwise(0)}).drop("_s", "_new", "_run")


def parkinson(df: DataFrame, n: int = 20) -> DataFrame:
    spread = F.ln(F.greatest(div("high", "low"), F.lit(1e-9)))
    df = df.withColumn("_x", spread * spread / (4 * log(2)))
    return df.withColumn("range_vol", roll(F.avg, "_x", n)).drop("_x")


def autocorrelation(df: DataFrame, n: int = 20) -> DataFrame:
    """Within each window of n returns, the correlation of its n-1 neighbouring pairs."""
    df = df.withColumn("_r", pct("close")).withColumn("_b", prev("_r"))
    w = ordered().rowsBetween(-(n - 2), 0)
    full = F.count("_r").over(ordered().rowsBetween(-(n - 1), 0)) >= n
    return df.withColumn("autocorr", F.when(full, F.corr("_r", "_b").over(w))).drop("_r", "_b")


def illiquidity(df: DataFrame, n: int = 20) -> DataFrame:
    """Return per volume and share of recent volume, both one row late."""
    df = df.withColumn("_v", F.when(F.col("volume") != 0, F.col("volume"))).withColumn("_a", div(F.abs(pct("close")), "_v"))
    df = df.withColumns({"_i": roll(F.avg, "_a", n), "_t": div("_v", roll(F.sum, "_v", n))})
    return df.withColumns({"amihud": prev("_i"), "turnover": prev("_t")}).drop("_v", "_a", "_i", "_t")


def illiquidity_by_value(df: DataFrame, n: int = 20) -> DataFrame:
    """Return per traded value, and volume over its recent maximum."""
    df = df.withColumn("_a", F.abs(pct("close")) / (F.col("close") * F.col("volume") + 1e-12))
    return df.withColumns({"amihud_value": roll(F.avg, "_a", n), "turnover_max": F.col("volume") / (roll(F.max, "volume", n) + 1e-12)}).drop("_a")


def event_time(df: DataFrame) -> DataFrame:
    """Returns, volatilities, distances, position, oscillators and corrected moments, all by simple windows."""
    df = df.withColumns({f"ret_{k}": pct("close", k) for k in (1, 5, 20)})
    df = df.withColumns({"vol_20": roll(F.stddev_samp, "ret_1", 20), "vol_60": roll(F.stddev_samp, "ret_1", 60), "_m20": roll(F.avg, "close", 20), "_m50": roll(F.avg, "close", 50)})
    low, high = roll(F.min, "close", 14), roll(F.max, "close", 14)
    gain = F.col("close") - prev("close")
    df = df.withColumns({"_g": F.when(gain > 0, gain).otherwise(0.0), "_l": F.when(gain < 0, -gain).otherwise(0.0)})
    up, down = roll(F.avg, "_g", 14), roll(F.avg, "_l", 14)
    w = ordered().rowsBetween(-19, 0)
    full = F.count("ret_1").over(w) >= 20
    return df.withColumns(
        {
            "vol_ratio": div("vol_20", "vol_60"),
            "dist_20": div("close", "_m20") - 1,
            "dist_50": div("close", "_m50") - 1,
            "bb_pos": (F.col("close") - F.col("_m20")) / (2 * F.col("vol_20") * prev("close") + TINY),
            "stoch_close": div(F.col("close") - low, high - low),
            "rsi_simple": up / (up + down + TINY),
            "skew_20": F.when(full, skew_corrected("ret_1", w)),
            "kurt_20": F.when(full, kurtosis_corrected("ret_1", w)),
            "overnight": pct("open") - F.col("ret_1"),
        }
    ).drop("_m20", "_m50", "_g", "_l")


def recursions(df: DataFrame) -> DataFrame:
    """All exponentially weighted features in one pass: ATR, RSI, EMA, MACD, ADX."""
    up, down = F.col("high") - prev("high"), prev("low") - F.col("low")
    df = df.withColumns(
        {
            "_tr": true_range(),
            "_gain": F.greatest(F.coalesce(F.col("close") - prev("close"), F.lit(0.0)), F.lit(0.0)),
            "_loss": F.greatest(F.coalesce(prev("close") - F.col("close"), F.lit(0.0)), F.lit(0.0)),
            "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_ndm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )

    def line(r: dict) -> float | None:
        a, b = r["_e12"], r["_e26"]
        return None if a is None or b is None else a - b

    def dx(r: dict) -> float:
        t = r["_str"]
        if t is None or t != t or not t:
            return 0.0
        p, n = 100 * r["_sp"] / t, 100 * r["_sn"] / t
        return 100 * abs(p - n) / (p + n) if p + n else 0.0

    df = recursive(
        df,
        [
            ("atr_14", "_tr", lambda: Ewm(14, 14)),
            ("_ag", "_gain", lambda: Ewm(14, 14)),
            ("_al", "_loss", lambda: Ewm(14, 14)),
            ("ema_12", "close", lambda: Ewm(12)),
            ("ema_26", "close", lambda: Ewm(26)),
            ("_e12", "close", lambda: Ewm(12, 12)),
            ("_e26", "close", lambda: Ewm(26, 26)),
            ("macd_signal", line, lambda: Ewm(9, 9)),
            ("_str", "_tr", lambda: Ewm(14, 14)),
            ("_sp", "_pdm", lambda: Ewm(14)),
            ("_sn", "_ndm", lambda: Ewm(14)),
            ("adx_14", dx, lambda: Ewm(14)),
        ],
    )
    df = df.withColumns({"macd": F.col("_e12") - F.col("_e26"), "rsi_14": 100 - 100 / (1 + div("_ag", "_al")), "di_plus": div("_sp", "_str") * 100, "di_minus": div("_sn", "_str") * 100})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_tr", "_gain", "_loss", "_pdm", "_ndm", "_ag", "_al", "_e12", "_e26", "_str", "_sp", "_sn")


def gaps(df: DataFrame) -> DataFrame:
    """Opening gaps, and their size by the previous average true range; wants ``atr_14``."""
    gap = div(F.col("open") - prev("close"), prev("close"))
    return df.withColumns({"gap": gap, "gap_by_atr": div(F.abs(gap), div("atr_14", prev("close")))})


def interactions(df: DataFrame) -> DataFrame:
    """Products of features that exist."""
    pairs = {"rsi_volume": ("rsi_14", "volume_ratio"), "bb_rsi": ("bb_place", "rsi_14"), "macd_volume": ("macd", "volume_ratio")}
    out = {k: F.col(a) * F.col(b) for k, (a, b) in pairs.items() if a in df.columns and b in df.columns}
    if "macd" in df.columns:
        out["macd_by_close"] = div("macd", "close")
    return df.withColumns(out | {"range_volume": true_range() * F.col("volume")})


def local_level(df: DataFrame, lags: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Lags of the filtered close; the filter's own value would see the day itself."""
    df = recursive(df, [("_level", "close", LocalLevel)])
    return df.withColumns({f"level_lag_{k}": prev("_level", k) for k in lags}).drop("_level")


def late(df: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    """The columns that exist, ``k`` rows late."""
    return df.withColumns({c: prev(c, k) for c in columns if c in df.columns})


LEAKY = ["macd", "macd_signal", "macd_hist", "rsi_14", "range_vol", "bb_mid", "bb_upper", "bb_lower"]


def base_features(df: DataFrame, keep: float = 0.9, older: bool = False) -> DataFrame:
    """All features of a sector's bars; rows with fewer than ``keep`` of them go. ``older``: without illiquidity, and nothing a row late."""
    first = df.columns
    for f in (event_time, ranges, volume_features, on_balance_volume, recursions, bollinger, stochastic, mean_convergence, rate_of_change, money_flow, chaikin, volume_shock, drawdown, streaks, parkinson, autocorrelation, *([] if older else [illiquidity])):
        df = f(df)
    df = moving_averages(df, (10, 20, 50))
    df = interactions(gaps(df))
    df = local_level(df if older else late(df, LEAKY))
    new = [c for c in df.columns if c not in first]
    return df.na.drop(thresh=int(keep * len(new)), subset=new)


def cross_pair(bars: DataFrame, target: str, other: str) -> DataFrame:
    """One row per date that both tickers have, the other's columns with the prefix ``o_``; the other's side is one ticker's bars."""
    a = bars.where(F.col("ticker") == target)
    b = bars.where(F.col("ticker") == other).select(*[F.col(c).alias(c if c == "date" else f"o_{c}") for c in bars.columns if c != "ticker"])
    return a.join(b, "date")


def relative(bars: DataFrame, benchmark: str, n: int = 60) -> DataFrame:
    """Relative strength, rolling beta and correlation, excess return, ratios and spreads of every ticker against a benchmark on a common grid."""
    own = bars.withColumns({"ret": pct("close"), "_tr": true_range()}).withColumn("range_14", roll(F.avg, "_tr", 14)).drop("_tr")
    bench = own.where(F.col("ticker") == benchmark).select("date", *[F.col(c).alias(f"b_{c}") for c in ("ret", "close", "volume", "range_14")])
    j = own.where(F.col("ticker") != benchmark).join(bench, "date")
    w = ordered().rowsBetween(-(n - 1), 0)
    both = F.when(F.col("ret").isNotNull() & F.col("b_ret").isNotNull(), 1)
    full = F.count(both).over(w) >= n
    return j.withColumns(
        {
            "strength": F.col("ret") / (F.col("b_ret") + TINY),
            "excess": F.col("ret") - F.col("b_ret"),
            "beta": F.when(full, F.covar_samp("ret", "b_ret").over(w) / (F.var_samp("b_ret").over(w) + 1e-12)),
            "corr": F.when(full, F.corr("ret", "b_ret").over(w)),
            "corr_5": F.when(F.count(both).over(ordered().rowsBetween(-4, 0)) >= 5, F.corr("ret", "b_ret").over(ordered().rowsBetween(-4, 0))),
            "price_ratio": F.col("close") / (F.col("b_close") + TINY),
            "volume_ratio": div("volume", "b_volume"),
            "range_ratio": div("range_14", "b_range_14"),
            "volume_range": F.col("volume") * F.col("range_14"),
            "spread": F.col("close") - F.col("b_close"),
        }
    )


def two_relatives(bars: DataFrame, sector: str | None, market: str | None, fallbacks: tuple[str | None, str | None] = (None, None), n: int = 60) -> DataFrame:
    """Relative strength and rolling beta of every ticker against its sector's fund and the market, on a common grid.

    A benchmark that has no bars is replaced by its fallback; without either its columns are NULL.
    """
    asked = {x for x in (sector, market, *fallbacks) if x}
    have = {r[0] for r in bars.where(F.col("ticker").isin(*asked)).select("ticker").distinct().collect()}  # at most four
    out = bars.withColumn("ret", pct("close"))
    w = ordered().rowsBetween(-(n - 1), 0)
    for name, choices in (("sector", (sector, fallbacks[0])), ("market", (market, fallbacks[1]))):
        bench = next((x for x in choices if x in have), None)
        if bench is None:
            out = out.withColumns({f"{name}_{c}": F.lit(None).cast("double") for c in ("strength", "beta")})
            continue
        # one ticker's returns by date: a row per day of the calendar
        own = bars.where(F.col("ticker") == bench).withColumn("_b", pct("close")).select("date", "_b")
        out = out.join(F.broadcast(own), "date", "left")
        full = F.count(F.when(F.col("ret").isNotNull() & F.col("_b").isNotNull(), 1)).over(w) >= n
        beta = F.when(full, F.covar_samp("ret", "_b").over(w) / (F.var_samp(F.when(F.col("ret").isNotNull(), F.col("_b"))).over(w) + 1e-12))
        out = out.withColumns({f"{name}_strength": F.col("ret") / (F.col("_b") + TINY), f"{name}_beta": beta}).drop("_b")
    return out


def stock_features(bars: DataFrame, sector: str | None, market: str | None, fallbacks: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """In one go, the base features of all tickers and their relatives to a sector's fund and the market."""
    names = [f"{b}_{c}" for b in ("sector", "market") for c in ("strength", "beta")]
    return base_features(bars, older=True).join(two_relatives(bars, sector, market, fallbacks).select("ticker", "date", *names), ["ticker", "date"])
