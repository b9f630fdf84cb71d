"""Features of macro series: one row per date, in the order of ``date`` within ``region`` (one value for a single economy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import ordered, past, prev, roll

def w():
    return ordered("region")


def z(c: str | Column, n: int, least: int) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return (x - roll(F.avg, x, n, least, w())) / (roll(F.stddev_samp, x, n, least, w()) + 1e-12)


def expanding(df: DataFrame, c: str, least: int) -> DataFrame:
    """Mean, deviation, z-score and percentile by what came before."""
    mean, sd = past(F.avg, c, least, w()), F.nullif(past(F.stddev_samp, c, least, w()), F.lit(0.0))
    return percentile(df.withColumns({f"{c}_mean": mean, f"{c}_std": sd, f"{c}_z": (F.col(c) - mean) / sd}), c)


def percentile(df: DataFrame, c: str) -> DataFrame:
    """The share of the values before that are at most this one; NULL for the first and for NULLs."""
    h = F.collect_list(c).over(w().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_h", h)
    return df.withColumn(f"{c}_pctile", F.when(F.col(c).isNotNull() & (F.size("_h") > 0), F.size(F.filter("_h", lambda x: x <= F.col(c))) / F.size("_h"))).drop("_h")


def curve_moments(df: DataFrame, short: str, mid: str, long: str) -> DataFrame:
    """Level, slope and curvature of three tenors, and their z-scores; nothing if one of them is missing."""
    if not {short, mid, long} <= set(df.columns):
        return df
    df = df.withColumns({"level": (F.col(short) + F.col(mid) + F.col(long)) / 3, "slope": F.col(long) - F.col(short), "curvature": F.col(long) - 2 * F.col(mid) + F.col(short)})
    return df.withColumns({f"{c}_z": z(c, 252, 60) for c in ("level", "slope", "curvature")})


def risk_appetite(df: DataFrame, spreads: list[str]) -> DataFrame:
    """z-scores of spreads over 21 and 252 rows; the composite is the negated mean of those that are known."""
    spreads = [s for s in spreads if s in df.columns]
    df = df.withColumns({f"{s}_z21": z(s, 21, 21) for s in spreads} | {f"{s}_z252": z(s, 252, 60) for s in spreads})
    known = F.array_compact(F.array(*[F.col(f"{s}_z252") for s in spreads]))
    return df.withColumn("risk_appetite", F.when(F.size(known) > 0, -F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))


def regimes(df: DataFrame, growth: str, inflation: str, fear: str) -> DataFrame:
    """A code of 2 growth + inflation + 3 risk, which collides, and one of 4 risk + 2 growth + inflation, which doesn't."""
    df = percentile(df, fear)
    g, i = (F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in (growth, inflation))
    r = F.coalesce((F.col(f"{fear}_pctile") < 0.8).cast("int"), F.lit(0))
    return df.withColumns({"regime_code": 2 * g + i + 3 * r, "regime_bits": 4 * r + 2 * g + i})


def simple_features(df: DataFrame, price: str, rate: str, base: str) -> DataFrame:
    """Change over twelve rows, slope, and z-scores by the past of both."""
    df = df.withColumns({"yoy": F.try_divide(F.col(price), F.lag(price, 12).over(w())) * 100 - 100, "carry": F.col(rate) - F.col(base)})
    return df.withColumns({f"{c}_z": (F.col(c) - past(F.avg, c, 12, w())) / F.nullif(past(F.stddev_samp, c, 12, w()), F.lit(0.0)) for c in ("yoy", "carry")})


def _late(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``df`` with new columns and their changes over five rows, all one row late."""
    hidden = df.withColumns({f"_{c}": x for c, x in made.items()})
    late = {c: prev(f"_{c}", 1, w()) for c in made} | {f"{c}_chg_5": prev(f"_{c}", 1, w()) - prev(f"_{c}", 6, w()) for c in made}
    return hidden.withColumns(late).drop(*[f"_{c}" for c in made])


def late_curve(df: DataFrame, ten: str, five: str, two: str, bill: str) -> DataFrame:
    """Level, slope (against the bill, else the two-year tenor) and curvature of the tenors that are there, with their changes over five rows, one row late."""
    have = set(df.columns)
    made = {}
    if ten in have:
        made["yc_level"] = F.col(ten)
        if short := next((c for c in (bill, two) if c in have), None):
            made["yc_slope_bill" if short == bill else "yc_slope_two"] = F.col(ten) - F.col(short)
        if {five, two} <= have:
            made["yc_curvature"] = F.col(ten) - 2 * F.col(five) + F.col(two)
    return _late(df, made)


def liquidity_proxies(df: DataFrame, funds: str, bill: str, ten: str) -> DataFrame:
    """Bill less funds rate, ten years less bill, ten years less funds rate, of the series that are there, with their changes over five rows, one row late."""
    have = set(df.columns)
    pairs = {"proxy_ted_like": (bill, funds), "term_slope": (ten, bill), "carry_ff": (ten, funds)}
    return _late(df, {c: F.col(a) - F.col(b) for c, (a, b) in pairs.items() if {a, b} <= have})


def state_features(df: DataFrame, ten: str, five: str, two: str, bill: str, funds: str, actual: str, expected: str) -> DataFrame:
    """The state of the economy: curve, liquidity and surprises, by date (components and their regimes: ``pca_regimes``)."""
    return surprises(liquidity_proxies(late_curve(df, ten, five, two, bill), funds, bill, ten), actual, expected)


def surprises(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """Actual less expected, and a stand-in for it: the z-score of the change; both one row late."""
    change = F.try_divide(F.col(actual), F.lag(actual, 1).over(w())) - 1
    df = df.withColumns({"_s": F.col(actual) - F.col(expected), "_c": change})
    df = df.withColumn("_p", z("_c", 24, 12))
    return df.withColumns({f"{actual}_surprise": prev("_s", 1, w()), f"{actual}_surprise_proxy_z": prev("_p", 1, w())}).drop("_s", "_c", "_p")


def pca_regimes(df: DataFrame, columns: list[str], k: int = 2, clusters: int = 3, seeds: int = 5, train_end: str | None = None) -> DataFrame:
    """Principal components of rolling z-scores and the cluster of each row, one row late.

    Columns with too few values or none that vary go.  Spark's PCA doesn't
    centre, so means are subtracted first; a component's largest loading is positive and
    clusters are numbered by their first coordinate, so results are stable.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stats = df.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    used = [c for c in columns if stats[f"n_{c}"] > 20 and (stats[f"s_{c}"] or 0) > 0]
    zs = df.withColumns({f"_z_{c}": F.coalesce(z(c, 252, 20), F.lit(0.0)) for c in used})
    train = zs.where(F.col("date") <= F.lit(train_end)) if train_end else zs
    means = train.agg(*[F.avg(f"_z_{c}").alias(c) for c in used]).first()
    zs = zs.withColumns({f"_z_{c}": F.col(f"_z_{c}") - F.lit(means[c]) for c in used})
    train = zs.where(F.col("date") <= F.lit(train_end)) if train_end else zs
    joined = VectorAssembler(inputCols=[f"_z_{c}" for c in used], outputCol="_v")
    k = min(k, len(used))
    pca = PCA(k=k, inputCol="_v", outputCol="_pc").fit(joined.transform(train))
    loadings = pca.pc.toArray()
    signs = [1.0 if abs(loadings[:, j].max()) >= abs(loadings[:, j].min()) else -1.0 for j in range(k)]
    a = vector_to_array("_pc")
    scored = pca.transform(joined.transform(zs)).withColumns({f"pc{j + 1}": a[j] * signs[j] for j in range(k)})
    parts = VectorAssembler(inputCols=[f"pc{j + 1}" for j in range(k)], outputCol="_x")
    # clusters, like components, know the rows up to ``train_end`` only
    known = parts.transform(scored.where(F.col("date") <= F.lit(train_end)) if train_end else scored)
    fitted = [KMeans(k=clusters, seed=s, featuresCol="_x", predictionCol="_k").fit(known) for s in range(seeds)]
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    order = sorted(range(len(best.clusterCenters())), key=lambda i: tuple(best.clusterCenters()[i]))
    named = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    out = best.transform(parts.transform(scored)).withColumn("_n", named[F.col("_k")])
    return out.withColumn("regime_km", prev("_n", 1, w())).select(*df.columns, *[f"pc{j + 1}" for j in range(k)], "regime_km")

