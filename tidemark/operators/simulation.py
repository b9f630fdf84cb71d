"""Account simulations: ordered folds over a ticker's bars.

Each fold is a small step function over a state.  Rows are partitioned by
ticker (and grid point), sorted once and streamed, so memory doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import importable


@dataclass
class Account:
    cash: float
    shares: int = 0
    buys: int = 0
    sells: int = 0
    entry: float = 0.0
    pending: float | None = None

    def trade(self, shares: int, price: float, commission: float) -> None:
        """To a number of shares at a price, as far as the cash goes."""
        change = shares - self.shares
        if change > 0:
            change = min(change, int(self.cash / (price * (1 + commission)))) if self.cash > 0 else 0
        if change == 0:
            return
        self.cash -= change * price + abs(change) * price * commission
        if self.shares * (self.shares + change) <= 0 or self.shares == 0:
            self.entry = price
        self.shares += change
        self.buys += change > 0
        self.sells += change < 0


def single_pass(a: Account, row: dict, commission: float, **_) -> None:
    """All in at the close on a signal over 0, all out on one under 0."""
    price, s = row["close"], row["signal"]
    if s > 0 and a.shares == 0:
        a.trade(int(a.cash / (price * (1 + commission))), price, commission)
    elif s < 0 and a.shares > 0:
        a.trade(0, price, commission)


def continuous_allocation(a: Account, row: dict, commission: float, share: float = 0.95, slip: float = 0.0005, stop: float = 0.05, **_) -> None:
    """A share of the equity while the signal is over 0, filled at the next open with slippage; out when the price falls by ``stop`` from the entry."""
    if a.pending is not None:
        worth = a.cash + a.shares * row["open"]
        want = int(worth * a.pending / row["open"])
        a.trade(want, row["open"] * (1 + slip if want > a.shares else 1 - slip), commission)
        a.pending = None
    if a.shares > 0 and row["low"] <= a.entry * (1 - stop):
        a.trade(0, min(row["open"], a.entry * (1 - stop)), commission)
    a.pending = share if row["signal"] > 0 else 0.0


def probabilistic(a: Account, row: dict, commission: float, share: float = 0.5, stop: float = 0.03, gain: float = 0.10, **_) -> None:
    """Long or short by probability up less probability down, with a stop and a target."""
    if a.pending is not None:
        worth = a.cash + a.shares * row["open"]
        want = int(worth * a.pending / row["open"])
        change = want - a.shares
        if change:
            a.cash -= change * row["open"] + abs(change) * row["open"] * commission
            a.entry, a.shares = row["open"], want
            a.buys, a.sells = a.buys + (change > 0), a.sells + (change < 0)
        a.pending = None
    if a.shares:
        move = (row["close"] / a.entry - 1) * (1 if a.shares > 0 else -1)
        if move <= -stop or move >= gain:
            a.cash += a.shares * row["close"] - abs(a.shares) * row["close"] * commission
            a.buys, a.sells, a.shares = a.buys + (a.shares < 0), a.sells + (a.shares > 0), 0
    a.pending = share * (2 * row["proba"] - 1)


STRATEGIES = {f.__name__: f for f in (single_pass, continuous_allocation, probabilistic)}


def simulate(rows: DataFrame, strategy: str = "single_pass", cash: float = 10_000_000.0, commission: float = 0.001, grid: list[str] | None = None) -> DataFrame:
    """(ticker, grid columns, date, balance, shares, buys, sells) per row of ``rows(ticker, date, open, low, close, signal or proba, grid columns)``.

    Grid columns are parameters of the strategy: each of their combinations is an account of its own.
    """
    importable(rows.sparkSession)
    grid = grid or []
    step = STRATEGIES[strategy]
    key = ["ticker", *grid]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, a = None, Account(cash)
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k = tuple(row[c] for c in key)
                if k != now:
                    now, a = k, Account(cash)
                step(a, row, commission, **{c: row[c] for c in grid})
                out.append((*k, row["date"], a.cash + a.shares * row["close"], a.shares, a.buys, a.sells))
            yield pd.DataFrame(out, columns=[*key, "date", "balance", "shares", "buys", "sells"])

    schema = "ticker string" + "".join(f", {c} double" for c in grid) + ", date date, balance double, shares long, buys long, sells long"
    return rows.repartition(*key).sortWithinPartitions(*key, "date").mapInPandas(run, schema)


def optimise(rows: DataFrame, strategy: str, grid: dict[str, list[float]], by: str = "total", within: tuple[str, ...] = (), **args) -> DataFrame:
    """Per ticker, and per value of the number columns ``within``, the grid point with the best total return or Sharpe ratio; the smallest of equals."""
    points = rows
    for c, values in grid.items():
        points = points.withColumn(c, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    names = [*within, *grid]
    sim = simulate(points, strategy, grid=names, **args)
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", *names).orderBy("date")
    r = sim.withColumn("r", F.try_divide(F.col("balance"), F.lag("balance").over(w)) - 1)
    s = r.groupBy("ticker", *names).agg((F.max_by("balance", "date") / F.min_by("balance", "date") - 1).alias("total"), F.coalesce(F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * 252**0.5, F.lit(0.0)).alias("sharpe"))
    rank = F.row_number().over(Window.partitionBy("ticker", *within).orderBy(F.desc(by), *grid))
    return s.withColumn("_k", rank).where("_k = 1").drop("_k")
