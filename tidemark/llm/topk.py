"""Exact top-k search over binary codes by incremental multi-index hashing (operator 7).

A vector's code has one bit per component: whether it is positive.  A 64-bit
code is cut into m segments, the wider the more distinct codes there are, so that a
segment's value has about eight of them; every segment value is a key of an index.  Round r looks up all values
within r bits of a query's segments.  A code at Hamming distance d has a segment
within floor(d/m) bits, so after round r all codes at distance up to
m * (r + 1) - 1 have been met.  A query is done once its kth best verified
distance is at most that; the others grow their radius.

Equal codes are one entry of the index with their k smallest ids, which are
the only ones that can be among the k best in order of distance and id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, discard, small_batches, table

K = 10
#: Bits of a code, least width of a segment, and codes that a segment's value should have.
BITS, LEAST_WIDTH, VALUE_CODES = 64, 8, 8
#: Rows over which the ids of one code are spread before its k smallest are taken.
SALTS = 64


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code): the 64-bit code of every vector with an id and components.

    Bit i is set if component i is over zero; NaN counts as over zero, null
    and missing components as zero.  Components from the 65th on are an error.
    """
    small_batches(vectors.sparkSession, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            if sizes.size and sizes.max() > 64:
                raise ValueError("a vector has over 64 components")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            null = lists.flatten().is_null().to_numpy(zero_copy_only=False)
            bit = ((flat > 0) | np.isnan(flat)) & ~null
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = np.zeros(b.num_rows, np.uint64)
            np.bitwise_or.at(out, np.repeat(np.arange(b.num_rows), sizes), bit.astype(np.uint64) << at.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["vec_id", "code"])

    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, code long")


def index(coded: DataFrame, k: int) -> DataFrame:
    """(code, ids): the distinct codes with their k smallest ids, ascending."""
    salted = Window.partitionBy("code", "salt").orderBy("vec_id")
    whole = Window.partitionBy("code").orderBy("vec_id")
    few = coded.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k)
    return few.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def segments(distinct: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments for so many distinct codes: as wide as gives a value some ``VALUE_CODES`` of them, at least ``LEAST_WIDTH`` bits."""
    m = max(1, min(BITS // LEAST_WIDTH, round(BITS / max(1.0, log2(max(distinct, 2) / VALUE_CODES)))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def _segment(code: F.Column, offset: int, width: int) -> F.Column:
    own = F.shiftrightunsigned(code, offset)
    return own if width == BITS else own.bitwiseAND(F.lit((1 << width) - 1))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): of each query the k vectors with the smallest Hamming distance, ties by the smallest vec_id.

    A vector with the id of the query is not among its own neighbours.  Fewer
    than k other vectors give as many rows.  Queries of equal id and code are
    one, and so are vectors; a null id or vector is no query and no neighbour.
    """
    small_batches(vectors.sparkSession, 4096)
    codes_k = cut(index(codes(vectors), k + 1), "codes")
    distinct, total = codes_k.agg(F.count("*"), F.sum(F.size("ids"))).first()
    parts = segments(distinct)
    keyed = cut(codes_k.select("code", "ids", F.posexplode(F.array(*[_segment(F.col("code"), o, w) for o, w in parts])).alias("segment", "value")), "index")
    asked = codes(queries).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).distinct()
    # of how many others a query waits for the best k: fewer only in tables of about as few vectors
    others = F.lit(k)
    if (total or 0) <= 10 * k:
        own = codes_k.select(F.explode("ids").alias("query_id")).groupBy("query_id").agg(F.count("*").alias("own"))
        asked = asked.join(F.broadcast(own), "query_id", "left")  # at most 10 k rows
        others = F.least(F.lit(k), F.lit(total or 0) - F.coalesce("own", F.lit(0)))
    asked = cut(asked.select("query_id", "query", others.cast("long").alias("need")), "queries")
    left, best, done = asked, None, []
    for radius in range(max(w for _, w in parts) + 1):
        masks = [np.array([sum(1 << i for i in at) for at in combinations(range(w), radius)], np.uint64) for _, w in parts]

        def probes(batches: Iterator[pa.RecordBatch], masks: list[np.ndarray] = masks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    ids, q = (b.column(c).to_numpy()[i : i + 64] for c in ("query_id", "query"))
                    for s, (o, w) in enumerate(parts):
                        own = q.view(np.uint64) >> np.uint64(o) & np.uint64((1 << w) - 1)
                        for j in range(0, len(masks[s]), 1 << 14):
                            m = masks[s][j : j + (1 << 14)]
                            values = (own[:, None] ^ m[None, :]).ravel().view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(m))), pa.array(np.repeat(q, len(m))), pa.array(np.full(len(values), s, np.int32)), pa.array(values)], ["query_id", "query", "s", "v"])

        asked_now = left.select("query_id", "query").mapInArrow(probes, "query_id long, query long, s int, v long")
        met = asked_now.hint("merge").join(keyed, (F.col("s") == F.col("segment")) & (F.col("v") == F.col("value"))).select("query_id", "query", "code", "ids").dropDuplicates(["query_id", "query", "code"])
        flat = met.select("query_id", "query", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int").alias("distance"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        if best is not None:
            flat = flat.unionByName(best.join(left.select("query_id", "query"), ["query_id", "query"], "left_semi"))
        rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "vec_id"))
        new = cut(flat.select("query_id", "query", "distance", "vec_id").distinct().withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")
        covered = len(parts) * (radius + 1) - 1
        near = new.where(F.col("distance") <= covered).groupBy("query_id", "query").agg(F.count("*").alias("n"))
        judged = left.join(near, ["query_id", "query"], "left").withColumn("full", F.coalesce("n", F.lit(0)) >= F.col("need"))
        # a row for every query that was asked in this round: the next round's queries are those that aren't full
        judged = cut(judged.select("query_id", "query", "need", "full"), "judged")
        done.append(new.join(judged.where("full").select("query_id", "query"), ["query_id", "query"], "left_semi"))
        best, left = new, judged.where("not full").drop("full")
        if left.isEmpty():
            break
    discard(codes_k, keyed, asked)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "vec_id"))
    return reduce(DataFrame.unionByName, done).withColumn("rank", rank).select("query_id", "rank", "vec_id", "distance")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, distance: the ``K`` nearest codes of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


OP7_SQL = f"""
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q JOIN c v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {K}
"""
