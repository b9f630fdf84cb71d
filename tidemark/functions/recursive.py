"""Recursions over the rows of a key: exponential weights, local-level filters.

Rows are partitioned by key and sorted once; a task streams through its rows
batch by batch and carries only the recursions' states, so memory doesn't
depend on how many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import importable


class Ewm:
    """y = (1 - a) y + a x with a = 2 / (span + 1), from the first value on; a gap of k rows decays the old weight by (1 - a)^k."""

    def __init__(self, span: float, least: int = 0) -> None:
        self.a, self.least = 2 / (span + 1), least
        self.y, self.seen, self.old = None, 0, 1.0

    def __call__(self, x: float | None) -> float | None:
        if x is None:
            self.old *= 1 - self.a
        elif self.y is None:
            self.y, self.seen, self.old = x, 1, 1.0
        else:
            w = self.old * (1 - self.a)
            self.y, self.seen, self.old = (w * self.y + self.a * x) / (w + self.a), self.seen + 1, 1.0
        return self.y if self.seen >= self.least else None


class EwmStd:
    """Bias-corrected exponentially weighted standard deviation with growing weights, NULL until ``least`` values (``span``)."""

    def __init__(self, span: float, least: int) -> None:
        self.a, self.least, self.n = 2 / (span + 1), least, 0
        self.w = self.w2 = self.mean = self.s = 0.0

    def __call__(self, x: float | None) -> float | None:
        d = 1 - self.a
        self.w, self.w2, self.s = self.w * d, self.w2 * d * d, self.s * d
        if x is not None:
            self.n += 1
            self.w, self.w2 = self.w + 1, self.w2 + 1
            gap = x - self.mean
            self.mean += gap / self.w
            self.s += gap * (x - self.mean)
        free = self.w * self.w - self.w2
        return (max(self.s / self.w * self.w * self.w / free, 0.0)) ** 0.5 if self.n >= self.least and free > 1e-12 else None


class LocalLevel:
    """Scalar local-level filter: first value as it is with variance 1, observation noise 1, state noise 0.01."""

    def __init__(self, noise: float = 1.0, drift: float = 0.01) -> None:
        self.m, self.p, self.r, self.q, self.first = None, 1.0, noise, drift, True

    def __call__(self, x: float | None) -> float | None:
        if x is None:
            return self.m
        if self.m is None:
            self.m = x
        if not self.first:
            self.p += self.q
        self.first = False
        k = self.p / (self.p + self.r)
        self.m += k * (x - self.m)
        self.p *= 1 - k
        return self.m


#: (new column, the column that feeds it, what makes its recursion); a later one may be fed by an earlier one, or by a function of the row so far.
Spec = tuple[str, "str | Callable[[dict], float | None]", Callable[[], Callable[[float | None], float | None]]]


def recursive(df: DataFrame, specs: list[Spec], key: str = "ticker", time: str = "date") -> DataFrame:
    """``df`` with a double column per spec; equal times of a key are in no defined order, null times come first."""
    importable(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, states = object(), []
        for pdf in batches:
            columns = {c: [None if pd.isna(v) else v for v in pdf[c].tolist()] for _, c, _ in specs if isinstance(c, str) and c in names}
            out: dict[str, list] = {n: [] for n, _, _ in specs}
            free = any(callable(c) for _, c, _ in specs)
            everything = pdf.to_dict("records") if free else None
            for i, k in enumerate(pdf[key].tolist()):
                if k != now:
                    now, states = k, [make() for _, _, make in specs]
                row = dict(everything[i]) if free else None
                for (name, c, _), state in zip(specs, states):
                    x = c(row) if callable(c) else columns[c][i] if c in columns else out[c][i]
                    x = None if x is None or x != x else x
                    y = state(x)
                    out[name].append(y)
                    if row is not None:
                        row[name] = y
            yield pdf.assign(**{n: pd.array(v, "Float64").to_numpy("float64", na_value=float("nan")) for n, v in out.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n, _, _ in specs)
    rows = df.repartition(key).sortWithinPartitions(key, time).mapInPandas(run, schema)
    from .exprs import finite

    return rows.select(*names, *[finite(n).alias(n) for n, _, _ in specs])
