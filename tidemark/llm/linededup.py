"""Reversible line dedup (operator 6): sharded cuckoo filters over exact reference counts.

A line's key is the line, white space stripped at both ends and A-Z lowered.
The index has two parts.  The exact table holds one row per key and document
(``references``); a key's count is the number of its documents, so a deleted
document takes its references with it and every effect of it is undone.  The
cuckoo filters, one or more per shard of the keys, hold the keys that are
frequent enough to be dropped; when a key crosses that border its fingerprint
is inserted or deleted.  Lines are probed against the filter of their shard,
and only those that hit are joined with the exact counts, which decide.

Keys are 128-bit hashes of the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, discard, fresh, in_arrow, let, small_batches, table, trim

#: A line is dropped if its key has at least this many characters and is in at least this many documents.
MIN_CHARS, MIN_DOCS = 20, 3
#: Frequent keys (about) of a shard of the filters, the least number of shards, and over how many tasks the lines of one shard are spread.
SHARD_KEYS, LEAST_SHARDS, SALTS = 50_000, 16, 8
#: A key with over one in so many of all references is hot: there are at most as many hot keys.
HOT = 1000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """Four 16-bit fingerprints per bucket; when a table is full another one of twice the size follows.

    No key that was inserted and not deleted is ever denied.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 256) -> None:
        self.tables: list[np.ndarray] = [np.zeros((buckets, self.SLOTS), np.uint16)]

    @staticmethod
    def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        mark = (k >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (k & np.uint64(buckets - 1)).astype(np.int64)
        return mark, first, first ^ CuckooFilter._step(mark, buckets)

    @staticmethod
    def _step(mark: np.ndarray, buckets: int) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(keys), bool)
        for t in self.tables:
            mark, a, b = self._split(keys, len(t))
            hit |= (t[a] == mark[:, None]).any(1) | (t[b] == mark[:, None]).any(1)
        return hit

    def insert(self, key: int) -> None:
        one = np.array([key], np.uint64)
        t = self.tables[-1]
        mark, a, b = (x[0] for x in self._split(one, len(t)))
        saved = None
        for i in (a, b):
            free = np.flatnonzero(t[i] == 0)
            if free.size:
                t[i, free[0]] = mark
                return
        saved, i = t.copy(), a
        for kick in range(self.KICKS):
            slot = (int(mark) + kick) % self.SLOTS
            mark, t[i, slot] = t[i, slot], mark
            i = i ^ self._step(np.array([mark]), len(t))[0]
            free = np.flatnonzero(t[i] == 0)
            if free.size:
                t[i, free[0]] = mark
                return
        t[:] = saved
        self.tables.append(np.zeros((2 * len(t), self.SLOTS), np.uint16))
        self.insert(key)

    def delete(self, key: int) -> bool:
        """Takes out one fingerprint of a key that was inserted."""
        for t in reversed(self.tables):
            mark, a, b = (x[0] for x in self._split(np.array([key], np.uint64), len(t)))
            for i in (a, b):
                found = np.flatnonzero(t[i] == mark)
                if found.size:
                    t[i, found[0]] = 0
                    return True
        return False

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of many keys: most take a free slot of their first or second bucket all at once, the rest are inserted one by one."""
        buckets = 256
        while buckets * cls.SLOTS < 2 * len(keys):
            buckets *= 2
        out, left = cls(buckets), keys.astype(np.uint64)
        t = out.tables[0]
        for which in (1, 2):
            mark, bucket = (x for i, x in enumerate(cls._split(left, buckets)) if i in (0, which))
            order = np.argsort(bucket, kind="stable")
            b = bucket[order]
            starts = np.flatnonzero(np.diff(b, prepend=-1))
            slot = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) + (t[b] != 0).sum(1)
            fits = slot < cls.SLOTS
            t[b[fits], slot[fits]] = mark[order][fits]
            left = left[order][~fits]
        for k in left.tolist():
            out.insert(k)
        return out

    def dump(self) -> bytes:
        """The number of tables, their sizes, and the tables."""
        return np.array([len(self.tables), *(len(t) for t in self.tables)], "<u4").tobytes() + b"".join(t.tobytes() for t in self.tables)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls()
        n = int(np.frombuffer(data, "<u4", 1)[0])
        at, out.tables = 4 * (n + 1), []
        for size in np.frombuffer(data, "<u4", n, 4).tolist():
            out.tables.append(np.frombuffer(data, np.uint16, size * cls.SLOTS, at).reshape(-1, cls.SLOTS).copy())
            at += size * cls.SLOTS * 2
        return out


def line_key(line: Column) -> Column:
    """The line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lowered (``lower`` is faster and does the same where every character is one byte)."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(plain, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER)), F.lit(_SPACE))


def row_of(text: Column) -> Column:
    """A hash of a text, null as the empty one: with its doc_id the identity of a row (equal rows lose the same lines)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, k1, k2): the lines of ``docs`` whose keys are long enough, by 128-bit hashes of the keys.

    ``row`` tells texts apart that share a doc_id.
    """
    lines = docs.select("doc_id", row_of(F.col("text")).alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= MIN_CHARS)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key", F.lit(2)).alias("k2"))


def references(lines: DataFrame) -> DataFrame:
    """(k1, k2, doc_id): one row per key and document."""
    return lines.select("k1", "k2", "doc_id").distinct()


def counts(refs: DataFrame) -> DataFrame:
    """(k1, k2, docs, last): how many documents hold a key, and the largest doc_id (null ids count as one document that is never the last)."""
    return refs.groupBy("k1", "k2").agg((F.count("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).cast("long").alias("docs"), F.max("doc_id").alias("last"))


def shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _filters(changes: DataFrame) -> DataFrame:
    """``changes(shard, old, k1, add)`` -> (shard, filter): inserts or deletes keys in the filters of their shards, in batches."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, waiting = None, []
        for b in batches:
            old = b.column("old").drop_null()
            if len(old):
                f = CuckooFilter.load(old[0].as_py())
            waiting.append(b.select(["k1", "add"]).filter(b.column("add").is_valid()))
        # any batch may bring the old filter, so changes wait for the last
        keys = np.concatenate([b.column("k1").to_numpy().view(np.uint64) for b in waiting])
        add = np.concatenate([b.column("add").to_numpy(zero_copy_only=False).astype(bool) for b in waiting])
        if f is None:
            f = CuckooFilter.of(keys[add])
        else:
            for k in keys[add].tolist():
                f.insert(k)
        for k in keys[~add].tolist():
            f.delete(k)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([f.dump()], pa.binary())], ["shard", "filter"])
        del f, waiting, keys, add
        trim()

    return changes.groupBy("shard").applyInArrow(run, "shard int, filter binary")


class LineIndex:
    """The references of a corpus and the filters over its frequent keys; every change gives a new index, tables in the shared folder.

    The number of shards follows the number of frequent keys when the index is built, and stays.
    """

    def __init__(self, refs: DataFrame, frequent: DataFrame, filters: DataFrame, shards: int) -> None:
        self.refs, self.frequent, self.filters, self.shards = refs, frequent, filters, shards

    @classmethod
    def build(cls, lines: DataFrame, with_refs: bool = True) -> LineIndex:
        """The index of the lines of a corpus; without ``with_refs`` the references are only counted, not kept for later changes."""
        refs = references(lines)
        if with_refs:
            refs = cut(refs, "refs")
        frequent = cut(counts(refs).where(F.col("docs") >= MIN_DOCS), "frequent")
        shards = max(LEAST_SHARDS, -(-frequent.count() // SHARD_KEYS))
        new = frequent.select(shard(shards).alias("shard"), F.lit(None).cast("binary").alias("old"), "k1", F.lit(True).alias("add"))
        return cls(refs, frequent, cut(_filters(new), "filters"), shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with documents added; those that it holds already change nothing."""
        return self._changed(cut(self.refs.unionByName(references(lines_of(docs))).distinct(), "refs"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents ``ids(doc_id)``: as if they had never been inserted.  A null id stands for all rows without one."""
        own = ids.select(F.col("doc_id").alias("gone_id")).distinct()
        return self._changed(cut(self.refs.join(own, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"), "refs"))

    def _changed(self, refs: DataFrame) -> LineIndex:
        frequent = cut(counts(refs).where(F.col("docs") >= MIN_DOCS), "frequent")
        key = ["k1", "k2"]
        up = frequent.join(self.frequent, key, "left_anti").select("k1", F.lit(True).alias("add"))
        down = self.frequent.join(frequent, key, "left_anti").select("k1", F.lit(False).alias("add"))
        change = up.unionByName(down).select(shard(self.shards).alias("shard"), F.lit(None).cast("binary").alias("old"), "k1", "add")
        old = self.filters.select("shard", F.col("filter").alias("old"), F.lit(0).cast("long").alias("k1"), F.lit(None).cast("boolean").alias("add"))
        return LineIndex(refs, frequent, cut(_filters(old.unionByName(change)), "filters"), self.shards)

    def probe(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` whose keys may be frequent: all that are, and few others.

        Lines go to the shard of their key and there to one of ``SALTS`` tasks.
        """
        f = self.filters.select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "shard", "filter", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("int").alias("pos"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
        rows = lines.select(F.pmod(F.xxhash64("doc_id", "row", "pos"), F.lit(SALTS)).cast("int").alias("salt"), shard(self.shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "doc_id", "row", "pos", "k1", "k2")
        n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        both = f.unionByName(rows).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, CuckooFilter] = {}
            for b in batches:
                salts, shards, blobs = b.column("salt").to_numpy(), b.column("shard").to_numpy(), b.column("filter")
                keys = b.column("k1").to_numpy().view(np.uint64)
                given = np.flatnonzero(~np.asarray(blobs.is_null()))
                hit = np.zeros(b.num_rows, bool)
                group = shards.astype(np.int64) * SALTS + salts
                starts = np.flatnonzero(np.diff(group, prepend=-1))
                for a, z in zip(starts, [*starts[1:], b.num_rows]):
                    at = int(group[a])
                    own = given[(given >= a) & (given < z)]
                    if own.size:
                        held = {at: CuckooFilter.load(blobs[int(own[0])].as_py())}
                    if at in held:
                        hit[a:z] = held[at].contains(keys[a:z])
                        hit[own] = False
                keep = pa.array(hit)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("doc_id", "row", "pos", "k1", "k2")], ["doc_id", "row", "pos", "k1", "k2"])

        return in_arrow(both, run, "doc_id long, row long, pos int, k1 long, k2 long")

    def dropped(self, lines: DataFrame) -> DataFrame:
        """(doc_id, row, gone): the positions of the lines that each row loses.

        Lines of hot keys (at most ``HOT`` of them) meet the exact counts in a
        broadcast join and need no filter, so no key with a large part of all
        lines is one task; all others are probed first.
        """
        exact = self.frequent.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "last", "docs")
        total = self.frequent.agg(F.sum("docs")).first()[0] or 0
        hot = F.col("docs") > total // HOT
        same = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))
        few = F.broadcast(exact.where(hot))
        rest = lines.join(few.select("f1", "f2"), same, "left_anti")
        found = lines.join(few, same).unionByName(self.probe(rest).join(exact.where(~hot), same))
        return found.where("doc_id is null or doc_id <> last").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, the frequent lines of ``text`` dropped, with n_lines (before) and n_dropped.

    A key of at least ``MIN_CHARS`` characters in at least ``MIN_DOCS``
    documents loses all its lines except in the largest doc_id that holds it.
    Null and empty texts have one empty line and stay empty.  Rows that share
    a doc_id are one document to the counts, but each loses its own lines only.
    Rows with a null doc_id count as one document and lose frequent lines.
    Columns named like the new ones are replaced.  An empty table stays empty.
    """
    small_batches(docs.sparkSession, 8192)
    lines = cut(lines_of(docs), "lines")
    key, row, gone = (fresh(docs, c) for c in ("_id", "_row", "_gone"))
    index = LineIndex.build(lines, with_refs=False)
    lost = cut(index.dropped(lines), "lost")
    discard(lines, index.frequent, index.filters)
    lost = lost.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("gone").alias(gone))
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(key)) & (row_of(F.col("text")) == F.col(row)), "left")
    whole = F.coalesce("text", F.lit(""))
    # by the positions that stay: linear in the lines
    left = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i))
    kept = F.when(F.col(gone).isNull(), whole).otherwise(F.array_join(let(F.split(whole, "\n"), left), "\n"))
    return joined.select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        kept.alias("text"),
        (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its frequent lines, n_chars counted anew."""
    names = {c: fresh(docs, f"_{c}") for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(names)).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in names.items()})
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
