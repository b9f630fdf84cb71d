"""Views of the driver's tables as bars, macro series and data sets, and file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import bday_add

BARS_SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one ticker per order priority; opening and closing price by order key."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


BARS = """bars AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""

#: Lags of the three macro series in business days.
LAGS = {"discount": 2, "tax": 1, "price": 5}


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series of the line items by shipping month, dated at the month's end."""
    return table(spark, sf_dir, "lineitem").groupBy(F.last_day(F.to_date("l_shipdate")).alias("date")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))


MACRO = """macro AS (
  SELECT last_day(CAST(l_shipdate AS DATE)) AS date, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1)"""


def macro_long(macro: DataFrame, names: list[str]) -> DataFrame:
    """(series_id, obs_date, value) of a wide macro table."""
    return macro.unpivot("date", names, "series_id", "value").withColumnRenamed("date", "obs_date")


def available(macro: DataFrame, lags: dict[str, int]) -> DataFrame:
    """A long macro table with ``available_date``, the observation's date plus its series' business days."""
    at = F.lit(None).cast("date")
    for name, n in lags.items():
        at = F.when(F.col("series_id") == name, bday_add("obs_date", n)).otherwise(at)
    return macro.withColumn("available_date", at)


def common_grid(rows: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """The rows of the dates that all keys have: a grouped count and a semi join."""
    n = rows.select(key).distinct().agg(F.count("*").alias("n"))
    full = rows.groupBy(date).agg(F.count_distinct(key).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(date)
    return rows.join(full, date, "left_semi")


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of CSV files with a header; rows that don't fit the schema carry their text in ``_corrupt_record``."""
    return spark.read.schema(f"{BARS_SCHEMA}, _corrupt_record string").csv(path, header=True, mode="PERMISSIVE")


def read_observations_json(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, obs_date, value) of JSON documents with a list of observations; values that are no numbers are NULL."""
    raw = spark.read.schema("series_id string, observations array<struct<date: string, value: string>>").json(path)
    return raw.select("series_id", F.explode("observations").alias("o")).select("series_id", F.expr("try_cast(o.date AS date)").alias("obs_date"), F.expr("try_cast(o.value AS double)").alias("value"))


def read_directory(spark: SparkSession, glob: str) -> DataFrame:
    """All CSV files of a folder as one table, with the data set's name from each file's name."""
    return spark.read.csv(glob, header=True).withColumn("dataset", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def read_trends(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """(date, trend_<keyword>, ...) of CSV files of search interest; the mark of unfinished weeks goes."""
    columns = ", ".join(["date date", *[f"`{k}` double" for k in keywords], "isPartial boolean"])
    raw = spark.read.schema(columns).csv(path, header=True, enforceSchema=False)
    return raw.drop("isPartial").withColumnsRenamed({k: f"trend_{k}" for k in keywords})


def read_each(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, rows, bad_rows, error) of each file of bars: one that can't be read is a row with its error and not an exception."""
    found = []
    for path in paths:
        try:
            d = read_bars_csv(spark, path)
            # a column that nothing asks for isn't parsed, and its bad cells aren't seen
            r = d.agg(F.count("*"), F.count("_corrupt_record"), *[F.count(c) for c in d.columns]).first()
            found.append((path, r[0], r[1], None))
        except Exception as e:  # noqa: BLE001 - whatever it is, it is the file's result
            found.append((path, None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return spark.createDataFrame(found, "path string, rows long, bad_rows long, error string")


def write_results(df: DataFrame, path: str) -> None:
    """A table of results as CSV and as JSON lines, in folders of these names."""
    df.write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.write.mode("overwrite").json(f"{path}/json")


def sector_and_ticker(name: str) -> tuple:
    """Columns sector and ticker of a data set's name: ``sector__ticker``, else its first and last part between underscores."""
    c = F.col(name)
    two = F.split(c, "__", 2)
    parts = F.split(c, "_")
    return F.when(c.contains("__"), two[0]).otherwise(parts[0]).alias("sector"), F.when(c.contains("__"), two[1]).otherwise(F.element_at(parts, -1)).alias("ticker")


def write_by_suffix(df: DataFrame, path: str) -> None:
    """Parquet or CSV, as the path ends."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown suffix: {path}")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base}/{what}-{uuid.uuid4().hex}"


def round_trip_csv(df: DataFrame) -> DataFrame:
    """Bars written as CSV with a header and read again with their schema."""
    path = scratch(df.sparkSession, "bars-csv")
    df.write.csv(path, header=True)
    return read_bars_csv(df.sparkSession, path)


def round_trip_parquet(df: DataFrame, by: str) -> DataFrame:
    """Written as Parquet in a folder per value of ``by`` and read again: a filter on it reads only its folders."""
    path = scratch(df.sparkSession, "parquet")
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def round_trip_results(df: DataFrame) -> DataFrame:
    """The rows that are equal in the CSV and in the JSON written of a table of results."""
    path = scratch(df.sparkSession, "results")
    write_results(df, path)
    read = df.sparkSession.read.schema(df.schema)
    return read.csv(f"{path}/csv", header=True).intersect(read.json(f"{path}/json"))


def round_trip_trends(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Search interest written as CSV files and read again."""
    path = scratch(df.sparkSession, "trends")
    df.select("date", *keywords, F.lit(False).alias("isPartial")).write.csv(path, header=True)
    return read_trends(df.sparkSession, path, keywords)


def round_trip_observations(long: DataFrame) -> DataFrame:
    """Observations written as JSON documents, a list per series and year, and read again."""
    path = scratch(long.sparkSession, "observations")
    o = F.struct(F.col("obs_date").cast("string").alias("date"), F.coalesce(F.col("value").cast("string"), F.lit(".")).alias("value"))
    long.groupBy("series_id", F.year("obs_date").alias("y")).agg(F.collect_list(o).alias("observations")).drop("y").write.json(path)
    return read_observations_json(long.sparkSession, path)


def manifest(df: DataFrame, sources: list[str], config: dict) -> str:
    """A JSON document of a table's hash, rows, columns and configuration."""
    import json

    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")).first()
    return json.dumps({"source_paths": sources, "inputs_hash": row[1], "rows": row[0], "cols": len(df.columns), "config": config}, sort_keys=True)
