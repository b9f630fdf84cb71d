"""Column expressions over ordered, keyed rows: guarded windows, null-safe arithmetic, business days."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

KEY, TIME = "ticker", "date"


def ordered(key: str | list[str] = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def roll(agg, c: str | Column, n: int, least: int | None = None, over: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows, NULL until ``least`` (n) of them are not null."""
    w = (over or ordered()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(w) >= (n if least is None else least), agg(col(c)).over(w))


def past(agg, c: str | Column, least: int = 1, over: WindowSpec | None = None) -> Column:
    """``agg`` over all rows before this one, NULL until ``least`` of them are not null."""
    w = (over or ordered()).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(col(c)).over(w) >= least, agg(col(c)).over(w))


def running(agg, c: str | Column, over: WindowSpec | None = None) -> Column:
    return agg(col(c)).over((over or ordered()).rowsBetween(Window.unboundedPreceding, 0))


def prev(c: str | Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    return F.lag(col(c), k).over(over or ordered())


def ahead(c: str | Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    return F.lead(col(c), k).over(over or ordered())


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def pct(c: str | Column, k: int = 1) -> Column:
    """Relative change over ``k`` rows (bars have no gaps once they are on a grid)."""
    return div(col(c), prev(c, k)) - 1


def finite(c: str | Column) -> Column:
    """NULL instead of NaN and infinities."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x held between bounds; a NULL bound doesn't bind, a NULL x stays NULL."""
    low, high = (b if isinstance(b, Column) else F.lit(float(b)) for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def bday_add(d: str | Column, n: int) -> Column:
    """``n`` >= 0 business days (Monday to Friday) after a date; a weekend counts as its Friday."""
    if n < 0:
        raise ValueError("n must not be negative")
    d = col(d)
    wd = F.weekday(d)
    if n == 0:
        return d
    five = F.least(wd, F.lit(4))
    return F.date_add(d, (F.lit(n) + 2 * F.floor((five + n) / 5) - F.greatest(wd - 4, F.lit(0))).cast("int"))


def round_all(df, digits: int = 6, keep: tuple[str, ...] = ()):
    """Doubles rounded, for results that are compared across engines; negative zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes])


def skew_corrected(c: str | Column, w: WindowSpec) -> Column:
    n = F.count(col(c)).over(w)
    return F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(col(c)).over(w)


def kurtosis_corrected(c: str | Column, w: WindowSpec) -> Column:
    n = F.count(col(c)).over(w)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(c)).over(w) + 6)
