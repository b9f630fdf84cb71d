"""Cleaning, pruning, and transforms that only look back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.exprs import clip, finite, ordered, past, prev, roll

_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in _NUMBERS or t.startswith("decimal")]


def split_numeric(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the number columns, and of the others (flags among them), in order."""
    n = numeric(df)
    return n, [c for c in df.columns if c not in n]


def recombine(df: DataFrame, like: list[str]) -> DataFrame:
    """Columns in the order of ``like``, new ones after them."""
    return df.select(*[c for c in like if c in df.columns], *[c for c in df.columns if c not in like])


def normalize_date(df: DataFrame, name: str | None = None) -> DataFrame:
    """The first of ``name``, date, Date and DATE that exists becomes ``date``, a day; what is no date is NULL."""
    found = next((c for c in (name, "date", "Date", "DATE") if c and c in df.columns), None)
    if found is None:
        raise KeyError(f"no date column among {df.columns}")
    kind = dict(df.dtypes)[found]
    day = F.to_date(found) if kind in ("date", "timestamp", "timestamp_ntz") else F.to_date(F.try_to_timestamp(F.col(found).cast("string")))
    return df.withColumn("_day", day).drop(found).withColumnRenamed("_day", "date")


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key: the first or last in order."""
    by = [F.col(c).asc_nulls_first() if keep == "first" else F.col(c).desc_nulls_last() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def validate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, no infinities or NaN, no column that is always NULL."""
    df = dedupe(df, keys, order)
    df = df.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    return drop_columns_under(df, 1)


def drop_columns_under(df: DataFrame, least: int) -> DataFrame:
    """Without columns that have fewer values than ``least``; one pass counts all."""
    found = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if found[c] >= least])


def drop_sparse(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Without columns of which fewer than ``share`` of all rows have a value."""
    found = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if found[c] >= int(share * found["_rows"])])


def drop_rows(df: DataFrame, share: float, columns: list[str]) -> DataFrame:
    """Without rows in which fewer than ``share`` of the columns have a value."""
    return df.na.drop(thresh=int(share * len(columns)), subset=columns)


def after_warm_up(df: DataFrame, rows: int = 60) -> DataFrame:
    """Without the first rows of each key that has more."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    return df.withColumns({"_k": F.row_number().over(ordered()), "_n": n}).where(f"_n <= {rows} or _k > {rows}").drop("_k", "_n")


def tail(df: DataFrame, rows: int = 750) -> DataFrame:
    """The last rows of each key by date."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_k") <= rows).drop("_k")


def head_and_tail(df: DataFrame, rows: int) -> DataFrame:
    w = Window.partitionBy("ticker")
    return df.withColumns({"_a": F.row_number().over(w.orderBy("date")), "_z": F.row_number().over(w.orderBy(F.desc("date")))}).where((F.col("_a") <= rows) | (F.col("_z") <= rows)).drop("_a", "_z")


def without_strings(df: DataFrame) -> DataFrame:
    return df.select(*[c for c, t in df.dtypes if t != "string"])


def shift(df: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    return df.withColumns({c: prev(c, k) for c in columns if c in df.columns})


def one_hot(df: DataFrame, c: str, values: list, prefix: str) -> DataFrame:
    """A flag per value: false where the column is NULL."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(c) == v, F.lit(False)) for v in values})


def prefilter(df: DataFrame, columns: list[str], nulls: float = 0.3) -> list[str]:
    """Number columns with at most so many NULLs that are not constant."""
    columns = [c for c in columns if c in numeric(df)]
    aggs = [x for c in columns for x in (F.avg(F.col(c).isNull().cast("int")).alias(f"n_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    row = df.agg(*aggs).first() if aggs else {}
    return [c for c in columns if row[f"n_{c}"] is not None and row[f"n_{c}"] <= nulls and (row[f"s_{c}"] or 0) > 0]


def impute(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """NULLs become the mean of the values before them."""
    return df.withColumns({c: F.coalesce(F.col(c), past(F.avg, c, least)) for c in columns})


def standardize(df: DataFrame, columns: list[str], least: int, sigmas: float | None = None) -> DataFrame:
    """By mean and deviation of the values before; a deviation of zero gives NULL."""

    def z(c: str):
        x = (F.col(c) - past(F.avg, c, least)) / (F.nullif(past(F.stddev_samp, c, least), F.lit(0.0)) + 1e-12)
        return clip(x, -sigmas, sigmas) if sigmas else x

    return df.withColumns({c: z(c) for c in columns})


def winsorize(df: DataFrame, columns: list[str], low: float, high: float, least: int) -> DataFrame:
    """Held between quantiles of the values before; too few of them bound nothing."""
    w = ordered().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_q_{c}": F.when(F.count(c).over(w) >= least, F.percentile(c, F.array(F.lit(low), F.lit(high))).over(w)) for c in columns})
    return df.withColumns({c: clip(F.col(c), F.get(f"_q_{c}", F.lit(0)), F.get(f"_q_{c}", F.lit(1))) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def chain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Winsorize, impute, standardize."""
    return standardize(impute(winsorize(df, columns, 0.01, 0.99, 200), columns, 20), columns, 60, 4.0)


def whole_sample_z(df: DataFrame, c: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clipped at quantiles of all rows of a ticker, by their mean and population deviation; NULL under five values."""
    q = df.groupBy("ticker").agg(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias("_q"), F.count(c).alias("_n"))
    x = df.join(q, "ticker").withColumn("_x", clip(F.col(c), F.get("_q", F.lit(0)), F.get("_q", F.lit(1))))
    m = x.groupBy("ticker").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    return x.join(m, "ticker").withColumn(f"{c}_z", F.when((F.col("_n") >= 5) & (F.col("_s") > 0), (F.col("_x") - F.col("_m")) / F.col("_s"))).drop("_q", "_n", "_x", "_m", "_s")


def volatility_regimes(df: DataFrame, ret: str, n: int = 252) -> DataFrame:
    """0, 1 or 2 as the rolling volatility is low, middling or high by its median over all rows of the ticker; NULL counts as 1."""
    df = df.withColumn("_v", roll(F.stddev_samp, ret, n))
    m = df.groupBy("ticker").agg(F.percentile("_v", 0.5).alias("_m"))
    return df.join(m, "ticker").withColumn("regime", F.when(F.col("_v") < 0.8 * F.col("_m"), 0).when(F.col("_v") > 1.2 * F.col("_m"), 2).otherwise(1)).drop("_v", "_m")


def assert_monotonic(df: DataFrame) -> None:
    """Raises if a key's rows, as ``seq`` numbers them, go back in date."""
    back = df.withColumn("_p", F.lag("date").over(Window.partitionBy("ticker").orderBy("seq"))).where("date < _p")
    if not back.isEmpty():
        raise ValueError("dates are not ascending")


def assert_no_future(stocks: DataFrame, macro: DataFrame, days: int = 31) -> None:
    """Raises if the macro table ends over ``days`` days before the last bar, or after it."""
    a, b = stocks.agg(F.max("date")).first()[0], macro.agg(F.max("date")).first()[0]
    if a is None or b is None or (a - b).days > days or b > a:
        raise ValueError(f"macro data end {b}, bars {a}")
