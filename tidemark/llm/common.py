"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import importable

#: Rows and bytes of an Arrow batch sent to Python (a single row may be larger).
BATCH_ROWS, BATCH_BYTES = 256, 1 << 24

#: Most rows of a table of ids that is broadcast: some MB.
MOST_BROADCAST = 100_000
#: Bits for each id in a map of more ids than that, and of a map at most: 8 MB.  A slot of it has so many.
ID_BITS, MOST_BITS, SLOT_BITS = 32, 1 << 26, 1 << 15
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this worker keeps from task to task.
_KEPT: dict[str, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of the Python operators of this session."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker, which keeps it until a task comes that does not name it (``in_arrow``)."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def keep_only(name: str | None) -> None:
    """Drops what the worker keeps for others: operators that follow one another share its memory."""
    gone = [k for k in _KEPT if k != name]
    for k in gone:
        del _KEPT[k]
    if gone:
        trim()


def trim() -> None:
    """Gives memory that is free back to the system: Arrow's pool and the C library hold the most that any task took until then."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        give(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow(run, schema)`` that leaves a worker no larger than it must be: it keeps what ``run`` keeps by the name ``keeps``, nothing else."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        yield from run(batches)
        trim()

    return df.mapInArrow(lean, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one beside the warehouse where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within are deleted when it ends: they stay else until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: its lineage and its shuffle files end there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with freeing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``cut`` wrote, once nothing will read it."""
    for df in tables:
        if path := getattr(df, "_tidemark_path", None):
            remove(df.sparkSession, path)


def let(x: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """f(x) with x evaluated once, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(x), f), 1)


def if_few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` for a join: broadcast if it has at most ``most`` rows (of some numbers each), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def among(rows: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``key`` is in ``ids`` (left_semi) or is not (left_anti); ``ids`` is a written table of that column.

    Up to ``MOST_BROADCAST`` ids are broadcast.  Of more a map of hashed bits is,
    and only the rows that it marks are shuffled to be compared: those of the
    ids and, up to ``MOST_BITS`` bits, some 3 % of the others.
    """
    n = ids.count()
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(ids), key, how)
    bits = min(MOST_BITS, 1 << (ID_BITS * n - 1).bit_length())
    slot, at, of = (fresh(rows, name) for name in ("_slot", "_at", "_map"))
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    placed = (F.floor(h / SLOT_BITS).alias(slot), (h % SLOT_BITS).alias(at))
    maps = ids.select(*placed).groupBy(slot).agg(F.bitmap_construct_agg(at).alias(of))
    byte = f"cast(conv(hex(substring(`{of}`, cast(`{at}` div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = F.expr(f"coalesce(shiftright({byte}, cast(`{at}` % 8 as int)) & 1, 0)") == 1
    looked = rows.select("*", *placed).join(F.broadcast(maps), slot, "left")
    found = looked.where(marked).select(*rows.columns).join(ids, key, how).select(*rows.columns)
    return found if how == "left_semi" else looked.where(~marked).select(*rows.columns).unionAll(found)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
