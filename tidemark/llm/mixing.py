"""Mixing sources to target weights by Pfair scheduling (operator 10, native).

Each source has an integer share p of the D shares in all: weight w = p / D.
Its documents, in order of doc_id, form blocks; block k (from 1) may take a
slot from its release floor((k-1)/w) on and before its deadline ceil(k/w).  In
every slot the released block with the earliest deadline goes (ties: the
first source).  As the weights add up to one every deadline is met, so after
any number t of slots a source has had t * w blocks, give or take less than one.

Every source that the documents name is scheduled on its own, null among them;
one without a stated share has ``DEFAULT_SHARE``.

The schedule repeats after D slots, as there every source has had p blocks
exactly.  So one period is scheduled, in one row, and block k of a source has
slot D * ((k-1) div p) + slot of its block ((k-1) mod p) + 1.  All of this is
SQL: the period has at most ``MAX_PERIOD`` slots (more is an error), which bounds
the one row and the broadcast table that comes of it; documents are numbered within
ranges of doc_id, so a source with a third of all rows is no single task.

A source that runs out leaves its slots empty.  No document is dropped or
repeated: the others go on at the same proportions to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, fresh, table
from .ordering import numbered, ranges

#: Documents of a block.
BLOCK_DOCS = 16
#: Most slots of a period: the sum of all shares.
MAX_PERIOD = 4096
#: The shares of the named sources, and of each other one (a null source too).
SHARES = {"src0": 8, "src1": 6, "src2": 5, "src3": 4, "src4": 3, "src5": 2, "src6": 1}
DEFAULT_SHARE = 1


def sources(docs: DataFrame, shares: dict[str, int], default: int) -> list[tuple[str | None, int]]:
    """(source, share) of every source of the documents, null first, then in order of name."""
    found = [r[0] for r in docs.select("source").distinct().limit(MAX_PERIOD + 1).collect()]
    out = [(x, shares.get(x, default) if x is not None else default) for x in sorted(found, key=lambda x: (x is not None, (x or "").encode("utf-8", "surrogatepass")))]
    if any(p < 1 for _, p in out) or sum(p for _, p in out) > MAX_PERIOD:
        raise ValueError(f"shares must be at least 1 and those of all sources add up to at most {MAX_PERIOD}")
    return out


def period(spark: SparkSession, of: list[tuple[str | None, int]]) -> DataFrame:
    """(stream, share, nth, slot, slots) of the blocks of one period: D rows, for the sources and shares ``of``."""
    parts = [p for _, p in of]
    d, n = sum(parts), len(parts)
    array = f"array({', '.join(f'{p}L' for p in parts)})"
    # done: blocks that each source has had.  The next block of source i is released at floor(done*D/p) and due at ceil((done+1)*D/p).
    step = f"""
      transform(sequence(1, {n}), i -> named_struct(
        'free', s.done[i-1] * {d}L div {array}[i-1] <= t,
        'due', ((s.done[i-1] + 1) * {d}L + {array}[i-1] - 1) div {array}[i-1], 'i', i))"""
    pick = f"array_min(transform(filter({step}, x -> x.free), x -> x.due * {n + 1}L + x.i)) % {n + 1}"
    rows = spark.sql(f"""
      SELECT aggregate(sequence(0L, {d - 1}L), named_struct('done', array_repeat(0L, {n}), 'out', cast(array() as array<long>)),
        (s, t) -> transform(array({pick}), c -> named_struct(
          'done', transform(s.done, (x, j) -> x + CASE WHEN j + 1 = c THEN 1L ELSE 0L END), 'out', concat(s.out, array(c))))[0],
        s -> s.out) AS chosen""")
    order = Window.partitionBy("i").orderBy("slot")
    names = F.array(*[F.lit(x).cast("string") for x, _ in of])
    shares = F.array(*[F.lit(p).cast("long") for p in parts])
    flat = rows.select(F.posexplode("chosen").alias("slot", "i"))
    return flat.select(F.element_at(names, F.col("i").cast("int")).alias("stream"), F.element_at(shares, F.col("i").cast("int")).alias("share"), F.row_number().over(order).cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"), F.lit(d).cast("long").alias("slots"))


def _placed(docs: DataFrame, shares: dict[str, int] | None, default: int, block: int, b: str, slot: str, place: str) -> DataFrame:
    """All columns of ``docs``, with the block, slot and place of every row under these names."""
    names = [*docs.columns, b, slot, place]
    of = sources(docs, SHARES if shares is None else shares, default)
    if not of:
        return docs.select("*", *[F.lit(0).cast(t).alias(c) for c, t in ((b, "long"), (slot, "long"), (place, "int"))])
    # one struct, so that no column of the documents meets those of the schedule
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"))
    rows = numbered(own, "_source", ["_doc"], ranges(own, "_doc"))
    rows = rows.select("_row", "_source", F.floor((F.col("nth") - 1) / block).alias("_block"), ((F.col("nth") - 1) % block).cast("int").alias("_place"))
    turn = F.broadcast(period(docs.sparkSession, of))  # at most MAX_PERIOD rows
    joined = rows.join(turn, F.col("_source").eqNullSafe(F.col("stream")) & (F.col("_block") % F.col("share") + 1 == F.col("nth")))
    out = joined.select("_row.*", (F.col("_block") + 1).alias(b), (F.floor(F.col("_block") / F.col("share")) * F.col("slots") + F.col("slot")).alias("_at"), F.col("_place").alias(place))
    return out.withColumnRenamed("_at", slot).select(*names)


def mix(docs: DataFrame, shares: dict[str, int] | None = None, default: int = DEFAULT_SHARE, block: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block (from 1 in its source), slot and place of every row: the mixture is in order of slot and place.

    Rows with equal doc_id and source are interchangeable, and each has a place
    of its own.  Null doc_ids come first.  An empty table gives none.
    """
    return _placed(docs.select("doc_id", "source"), shares, default, block, "block", "slot", "place")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, place of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def _sql() -> str:
    share = " ".join(f"WHEN '{n}' THEN {p}" for n, p in sorted(SHARES.items()))
    return f"""
WITH RECURSIVE s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i, CASE source {share} ELSE {DEFAULT_SHARE} END AS p FROM (SELECT DISTINCT source FROM documents)
), shares AS (SELECT list(p ORDER BY i) AS ps, sum(p)::BIGINT AS d, count(*)::BIGINT AS n FROM s),
run(t, done, chosen) AS (
  SELECT -1::BIGINT, list_transform(ps, lambda x: 0::BIGINT), 0::BIGINT FROM shares
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: x + CASE WHEN j = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t, done, list_min(list_transform(list_filter(range(1, n + 1), lambda i: done[i] * d // ps[i] <= t + 1), lambda i: ((done[i] + 1) * d + ps[i] - 1) // ps[i] * (n + 1) + i)) % (n + 1) AS pick
    FROM run, shares WHERE t + 1 < d)
), turn AS (
  SELECT s.source, s.p, t AS slot, row_number() OVER (PARTITION BY s.i ORDER BY t) AS nth FROM run JOIN s ON run.chosen = s.i
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS k FROM documents
)
SELECT doc_id, r.source, k // {BLOCK_DOCS} + 1 AS block, k // {BLOCK_DOCS} // turn.p * d + turn.slot AS slot, CAST(k % {BLOCK_DOCS} AS INTEGER) AS place
FROM r JOIN turn ON r.source IS NOT DISTINCT FROM turn.source AND (k // {BLOCK_DOCS}) % turn.p + 1 = turn.nth, shares
"""


OP10_SQL = _sql()


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, the rows in order of the mixture: what is written is sorted over all its files."""
    b, slot, place = (fresh(docs, c) for c in ("_block", "_slot", "_place"))
    return _placed(docs, None, DEFAULT_SHARE, BLOCK_DOCS, b, slot, place).orderBy(slot, place).select(*docs.columns)


def in_mixture(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``slot`` and ``place`` in the mixture, ordered by them: files that were read again have no order of their own.

    The rows are written first, as they are read more than once.
    """
    rows = cut(rows.drop("slot", "place"), "mixed")
    b = fresh(rows, "_block")
    return _placed(rows, None, DEFAULT_SHARE, BLOCK_DOCS, b, "slot", "place").drop(b).orderBy("slot", "place")
