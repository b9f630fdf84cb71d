"""The registry of queries, and builders of the SQL that they are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.views import BARS, MACRO, bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

W = "PARTITION BY ticker ORDER BY date"
MW = "ORDER BY date"


def rounded(df: DataFrame, doubles: list[str], digits: int) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def add(name: str, run: Callable[[SparkSession, str], DataFrame], columns: list[str], doubles: list[str], sql: str | None = None, digits: int = 6) -> None:
    """Registers a query: ``columns`` and ``doubles`` (rounded on both sides) of what ``run`` gives; ``sql`` selects the same."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(run(spark, sf_dir).select(*columns, *doubles), doubles, digits)

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        names = ", ".join([*columns, *[f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles]])
        body = sql.strip()
        head = "WITH RECURSIVE " if body.startswith("RECURSIVE ") else "WITH "
        body = body.removeprefix("RECURSIVE ")
        used = [x for x, n in ((BARS, "bars"), (MACRO, "macro")) if re.search(rf"\b{n}\b", body)]
        ctes, _, select = ("\n" + body).rpartition("\n====\n")
        parts = ", ".join([*used, *([ctes.strip().rstrip(",")] if ctes.strip() else [])])
        SQL[name] = f"{head if parts else ''}{parts}\nSELECT {names} FROM ({select}) AS result"


def on_bars(name: str, f: Callable[[DataFrame], DataFrame], columns: list[str], doubles: list[str], sql: str | None = None, digits: int = 6, keys: tuple[str, ...] = ("ticker", "date")) -> None:
    add(name, lambda spark, d: f(bars(spark, d)), [*keys, *columns], doubles, sql, digits)


def roll(agg: str, c: str, n: int, least: int | None = None, w: str = W) -> str:
    over = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {over} >= {n if least is None else least} THEN {agg}({c}) OVER {over} END"


def past(agg: str, c: str, least: int = 1, w: str = W) -> str:
    over = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {over} >= {least} THEN {agg}({c}) OVER {over} END"


def lag(c: str, k: int = 1, w: str = W) -> str:
    return f"lag({c}, {k}) OVER ({w})"


def pct(c: str, k: int = 1, w: str = W) -> str:
    return f"({c} / nullif({lag(c, k, w)}, 0) - 1)"


def ewm(c: str, span: int, least: int = 1) -> str:
    """Over values that are all NULL up to some row and none after."""
    over = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    a = 2 / (span + 1)
    return f"CASE WHEN count({c}) OVER {over} >= {least} THEN list_reduce(list({c}) FILTER (WHERE {c} IS NOT NULL) OVER {over}, lambda y, x: {1 - a!r} * y + {a!r} * x) END"
