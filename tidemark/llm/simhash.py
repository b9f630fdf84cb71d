"""SimHash near-duplicates with Golay-code fuzzy keys (operator 1).

A text's fingerprint has 64 bits: bit i is set if it is set in over half of
the hashes of the text's shingles.  To find all pairs of fingerprints at three
or fewer differing bits without comparing all, a fingerprint is cut into three
segments of 22, 21 and 21 bits.  Three errors leave at most one error in each
of at least two segments.  A segment with at most one error has the nearest
Golay codeword of either side among the codewords near the other side (see
``golay``), so for each two segments one side gives the pair of its nearest
codewords as a key and the other the pairs of all its near ones (1 to 36): equal
keys propose a pair, and the differing bits decide within the join.

Only distinct fingerprints are joined.  A fingerprint has at most 43,744
others within three bits, so links grow with the number of fingerprints and not
with the square of a group, and copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import among, cut, discard, freeing, fresh, in_arrow, small_batches, table, trim
from .components import connected_components
from .golay import codewords, nearby
from .masked import SHARD_KEYS, pack, packed_texts, pressed, unpressed

SEED = 42
MAX_BITS = 3
#: Offset and width of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are unpacked at once: bounds the memory for a very long text.
_AT_ONCE = 1 << 16


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def shingles(text: str | bytes | None, words: int) -> list[bytes]:
    """The word shingles of a text (or its UTF-8), A-Z lowered, repeats included; the whole sequence if it has fewer words."""
    w = (text if isinstance(text, bytes) else _plain(text)).translate(_LOWER).split()
    if not w:
        return []
    if len(w) < words:
        return [b" ".join(w)]
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)))))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text; zero for a text without words, null included."""
    found = shingles(text, words)
    if not found:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), _AT_ONCE):
        part = found[i : i + _AT_ONCE]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint as a signed long) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    whole = fresh(docs, "_text")
    kept = docs.select(*keep, F.col("text").alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop(whole).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(b.num_columns - 1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*b.schema.names[:-1], "fp"])

    return in_arrow(kept, run, f"{schema}, fp long")


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, fuzzy, owner): one key per two segments for each fingerprint, shape (n, 3); all fuzzy keys, and the row that each belongs to."""
    near = [nearby((fps >> np.uint64(o) & np.uint64((1 << w) - 1)).astype(np.int64)).astype(np.int64) for o, w in SEGMENTS]
    own, fuzzy, owner = [], [], []
    for t, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        own.append(t << 24 | near[a][:, 0] << 12 | near[b][:, 0])
        both = t << 24 | near[a][:, :, None] << 12 | near[b][:, None, :]
        row, i, j = np.nonzero((near[a][:, :, None] >= 0) & (near[b][:, None, :] >= 0))
        fuzzy.append(both[row, i, j])
        owner.append(row)
    return np.stack(own, 1), np.concatenate(fuzzy), np.concatenate(owner)


def links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``, the pairs at 1 to 3 differing bits (a pair may come twice; a > b)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            k, _, _ = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(fps, 3))], ["key", "a"])

    def fuzzy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            _, k, row = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[row])], ["key", "b"])

    # a fingerprint has some 85 fuzzy keys: dealt anew, as there are few files of them
    distinct = distinct.repartition(max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "fp")
    left = in_arrow(distinct, own, "key long, a long")
    right = in_arrow(distinct, fuzzy, "key long, b long")
    return left.hint("merge").join(right, (left.key == right.key) & (left.a > right.b) & (F.bit_count(left.a.bitwiseXOR(right.b)) <= MAX_BITS)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of three or
    fewer differing bits, the row's own included.  Texts without words (null
    and empty ones too) have fingerprint zero and link like any other.
    Repeated rows keep their number; null doc_ids never are a component's id
    unless it has no other, and then it is null.
    """
    fps = cut(fingerprints(docs, words, tuple(dict.fromkeys(("doc_id", *keep)))), "fps")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = connected_components(links(distinct.select("fp")))
    roots = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots, "roots")
    discard(found)
    smallest = roots.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    labelled = roots.join(smallest, roots.root == smallest.r).select(F.col("fp").alias("f"), "component_id")
    return fps.join(labelled, fps.fp == labelled.f, "left").select(*keep, "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document, with three-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similar documents: the same idea with a threshold on shingle sets.
#
# At a Jaccard similarity of 0.8 some 15 % of SimHash bits differ, so exact
# bounds on errors per segment no longer help.  Here a fingerprint has six
# segments of 23 sums (how many more hashes have the bit than have not), and a segment is
# decoded softly: to the ``NEAR`` codewords with the largest products with
# the sums, which hold nearly always under small changes.  Two segments
# make a key, and similar texts share one of 60 or so with high probability.
# In a bucket a text is proposed with the closest of those before it, if that
# is close enough; the Jaccard similarity of the two shingle sets decides.
# These proposals join most of a group, but not all of it: the closest by bits
# need not be the similar one.  So pairs between the groups are completed by the
# prefixes of the shingle sets, which miss none: rarest shingles first, by their
# number of documents in all rows, so that a text shares few of its first.

SIMILARITY, SHINGLE_WORDS = 0.8, 5
#: Segments and codewords per segment; differing bits (of 138) up to which texts are proposed, and at which one stands for the other.
SOFT_SEGMENTS, NEAR, CLOSE_BITS, SAME_BITS = 6, 2, 40, 3
#: Proposals of a document that are verified; the prefixes complete the rest.
CLOSEST = 3
#: Bits of a shingle's hash, beside its shard's, by which it is counted: equal ones among rare shingles only change the order.
KEY_BITS = 40
#: Columns with the parities of a set: 256 bits in four longs.
PARITIES = ("m0", "m1", "m2", "m3")
_PREFIX = "key long, doc_id long, at long, m0 long, m1 long, m2 long, m3 long"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    found = shingles(text, words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found)))


def soft_sums(hashes: np.ndarray) -> np.ndarray:
    """(192,) for each bit of three words made of a hash, how many more of the hashes have it than have not."""
    total = np.zeros(192, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        h = hashes[i : i + _AT_ONCE]
        three = np.stack([h, *((h ^ h >> np.uint64(29)) * np.uint64(m) for m in _MIX)], 1)
        total += 2 * np.unpackbits(three.view(np.uint8).reshape(len(h), 24), axis=1, bitorder="little").sum(0, dtype=np.int64) - len(h)
    return total


def soft_keys(sums: np.ndarray) -> np.ndarray:
    """(n, keys) of (n, 192) sums: for each two segments the pairs of their best codewords."""
    best = []
    for s in range(SOFT_SEGMENTS):
        product = sums[:, 23 * s : 23 * s + 23].astype(np.float32) @ codewords().T
        found = []
        for _ in range(NEAR):
            found.append(product.argmax(1))
            product[np.arange(len(product)), found[-1]] = -np.inf
        best.append(found)
    pairs = [(a, b) for a in range(SOFT_SEGMENTS) for b in range(a + 1, SOFT_SEGMENTS)]
    return np.stack([t << 24 | i << 12 | j for t, (a, b) in enumerate(pairs) for i in best[a] for j in best[b]], 1).astype(np.int64)


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s0, s1, f0, f1, f2, keys) of the documents with an id and a word; s0 and s1 are a 128-bit hash of the shingle set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            whole = np.array([[xxhash.xxh64_intdigest(sets[i].tobytes(), seed) for seed in (0, 1)] for i in some], np.uint64).reshape(-1, 2).view(np.int64)
            sums = np.array([soft_sums(sets[i]) for i in some], np.int64).reshape(-1, 192)
            bits = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64).reshape(-1, 3)
            k = soft_keys(sums)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array([len(sets[i]) for i in some], pa.int32()), *(pa.array(whole[:, j].copy()) for j in range(2)), *(pa.array(bits[:, j].copy()) for j in range(3)), pa.ListArray.from_arrays(np.arange(0, k.size + 1, max(k.shape[1], 1), dtype=np.int32) if len(some) else pa.array([0], pa.int32()), pa.array(k.ravel()))], ["doc_id", "n", "s0", "s1", "f0", "f1", "f2", "keys"])

    return in_arrow(docs.where("doc_id is not null").select("doc_id", "text"), run, "doc_id long, n int, s0 long, s1 long, f0 long, f1 long, f2 long, keys array<long>")


_BITS = np.array([(1 << 64) - 1, (1 << 64) - 1, (1 << 10) - 1], np.uint64)  # 138 bits


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and doc_id -> (a, b, bits): each document with the closest one before it in its bucket, and by how many bits they differ.

    A document within ``SAME_BITS`` of one before it is proposed with that and not held itself.
    """
    now, held, size, ids = None, np.zeros((64, 3), np.uint64), 0, np.zeros(64, np.int64)
    for b in batches:
        keys, doc = b.column("key").to_numpy(), b.column("doc_id").to_numpy()
        f = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1", "f2")], 1) & _BITS
        out_a, out_b, bits = [], [], []
        # a bucket of one row has nothing to propose
        alone = np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [False]])
        for i in np.flatnonzero(~alone).tolist() if b.num_rows else []:
            if keys[i] != now:
                now, size = keys[i], 0
            close = SAME_BITS + 1
            if size:
                d = np.bitwise_count(held[:size] ^ f[i]).sum(1)
                j = int(d.argmin())
                close = int(d[j])
                if close <= CLOSE_BITS:
                    out_a.append(int(doc[i]))
                    out_b.append(int(ids[j]))
                    bits.append(close)
            if close > SAME_BITS:
                if size == len(ids):
                    held, ids = np.concatenate([held, np.zeros_like(held)]), np.concatenate([ids, np.zeros_like(ids)])
                held[size], ids[size] = f[i], doc[i]
                size += 1
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(bits, pa.int32())], ["a", "b", "bits"])


def _least_shared(similarity: float, n: np.ndarray | int) -> np.ndarray:
    """The least whole number at or over similarity * n, rounding errors allowed for."""
    return np.ceil(similarity * np.asarray(n, np.float64) - 1e-6).astype(np.int64)


def _block_sets(sizes: pa.ListScalar, data: pa.BinaryScalar, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths) of a block: the shingle sets of its texts end to end, and the size of each."""
    sets = [shingle_set(t, words) for _, part in packed_texts(sizes, data) for t in part]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS - bits)


def _five(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _frequencies(packed: DataFrame, words: int, bits: int) -> DataFrame:
    """(block, found): for each shard of hashes the numbers of documents that have the block's distinct short keys, in their order.

    A block sends its keys to the shards of their first ``bits`` bits; a shard adds up and answers every block.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                distinct, count = np.unique(_short(_block_sets(b.column(1)[i], b.column(2)[i], words)[0], bits), return_counts=True)
                shard = (distinct >> np.uint64(KEY_BITS)).astype(np.int32)
                starts = np.flatnonzero(np.diff(shard, prepend=-1))
                parts = list(zip(starts, [*starts[1:], len(shard)]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), pa.array(np.full(len(parts), b.column(0)[i].as_py(), np.int64)), pa.array([_five(distinct[a:z]) for a, z in parts], pa.binary()), pa.array([pressed(count[a:z]) for a, z in parts], pa.binary())], ["shard", "block", "keys", "documents"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, keys, counts = [], [], []
        for b in batches:
            blocks += b.column("block").to_pylist()
            keys += map(_from_five, b.column("keys").to_pylist())
            counts += map(unpressed, b.column("documents").to_pylist())
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)[which]
        ends = np.cumsum([len(k) for k in keys])
        for block, k, z in zip(blocks, keys, ends.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([key[0].as_py()], pa.int32()), pa.array([pressed(total[z - len(k) : z])], pa.binary())], ["block", "shard", "totals"])
        del blocks, keys, counts, which, total, k
        trim()

    asked = in_arrow(packed.select("block", "sizes", "data"), ask, "shard int, block long, keys binary, documents binary")
    totals = asked.groupBy("shard").applyInArrow(add, "block long, shard int, totals binary")
    return totals.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("found"))


def parities(hashes: np.ndarray) -> np.ndarray:
    """(4,) longs of 256 bits: whether an odd number of the hashes end in the bit's number.  Two sets differ in at least as many hashes as bits."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefixes(rows: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(doc_id, text)`` -> (key, doc_id, at, parities): of the first shingles of every set those that another set may have; two similar sets share one of them at least.
    Two tables to discard when those are written come with them.

    ``at`` holds the size of the set and the place of the shingle in it (32 bits each).
    Sets of p and q at the similarity s share at least s * max(p, q), so one of p
    without its last ceil(s * p) - 1 still has a shared one, the first shared in the order of all.
    That order is by the number of documents, counted over all rows, then by hash: what is in one document only comes first and is not sent.
    """
    packed = pack(rows, prepare=_plain)
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, (total // 6 // SHARD_KEYS).bit_length())
    # written: what is sent for it is gone before the blocks and the prefixes are shuffled
    found = cut(_frequencies(packed, words, bits).withColumnRenamed("block", "b"), "found")
    both = packed.hint("merge").join(found, F.col("block") == F.col("b")).select("rows", "sizes", "data", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc = b.column(0)[i].values.field(0).to_numpy()
                hashes, lengths = _block_sets(b.column(1)[i], b.column(2)[i], words)
                totals = np.concatenate([unpressed(x["totals"]) for x in b.column(3)[i].as_py()])
                short = _short(hashes, bits)
                # numbers over 16 bits are alike: they are sorted by radix
                often = np.minimum(totals, 65535).astype(np.uint16)[np.searchsorted(np.unique(short), short)]
                key, at, bits_of, each = [], [], [], np.zeros(len(lengths), np.int64)
                first = np.where(lengths > 0, lengths - _least_shared(similarity, lengths) + 1, 0)
                ends = np.cumsum(lengths)
                for j, (z, n, m) in enumerate(zip(ends.tolist(), lengths.tolist(), first.tolist())):
                    own = often[z - n : z]
                    alone = int(np.count_nonzero(own == 1))
                    if alone < m:
                        order = np.argsort(own, kind="stable")[alone:m]
                        key.append(hashes[z - n : z][order])
                        at.append(n << 32 | np.arange(alone, m, dtype=np.int64))
                        bits_of.append(parities(hashes[z - n : z]))
                        each[j] = m - alone
                if key:
                    odd = np.repeat(np.stack(bits_of), each[each > 0], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.repeat(doc, each)), pa.array(np.concatenate(at)), *(pa.array(odd[:, c].copy()) for c in range(len(PARITIES)))], ["key", "doc_id", "at", *PARITIES])

    return in_arrow(both, run, _PREFIX), packed, found


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key comes more than once: most shingles are in one document only."""
    last, last_waits = None, True
    for b in batches:
        if not b.num_rows:
            continue
        whole = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0] if last is not None else b
        key = whole.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        # the last row stands for its key in the next batch, unless it goes out already
        known, last_waits = not last_waits, not keep[-1]
        if known:
            keep[0] = False
        yield whole.filter(pa.array(keep))
        last = whole.slice(whole.num_rows - 1)


def _across(similarity: float, all_pairs: bool):
    """Rows sorted by key and ``at`` -> (a, b): documents of different roots that may be similar by their sizes, the places of the key and the parities of their sets.

    Without ``all_pairs`` one pair of each document and root, the first found.
    """
    names = ("key", "doc_id", "root", "at", *PARITIES)

    def bucket(doc: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        out_a, out_b, size = [], [], 0
        ends = np.searchsorted(n, np.floor(n / similarity + 1e-6), side="right")  # n ascends
        for i in range(len(doc) - 1):
            z = int(ends[i])
            if z <= i + 1:
                continue
            o = slice(i + 1, z)
            least = _least_shared(similarity / (1 + similarity), n[i] + n[o])
            j = np.flatnonzero((root[o] != root[i]) & (np.minimum(n[i] - pos[i], n[o] - pos[o]) >= least))
            # sets that share enough differ in few hashes, and in no more parities
            j = j[np.bitwise_count(odd[o][j] ^ odd[i]).sum(1, dtype=np.int64) <= (n[i] + n[o] - 2 * least)[j]] + i + 1
            if not all_pairs and len(j) > 1:
                j = j[np.unique(root[j], return_index=True)[1]]
            if len(j):
                out_a.append(np.maximum(doc[i], doc[j]))
                out_b.append(np.minimum(doc[i], doc[j]))
                size += len(j)
            if size >= _AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    def ready(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, doc, root, at, *odd = (np.concatenate([p[c] for p in parts]) for c in range(len(names)))
        odd = np.stack(odd, 1).view(np.uint64)
        n, pos = at >> 32, at & 0xFFFFFFFF
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        for a, z in zip(starts[mixed].tolist(), np.append(starts[1:], len(key))[mixed].tolist()):
            yield from bucket(doc[a:z], root[a:z], n[a:z], pos[a:z], odd[a:z])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in names]
            # the last bucket may go on in the next batch
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if held and held[-1][0][-1] != rows[0][0]:
                yield from ready(held)
                held = []
            if last:
                yield from ready([*held, [r[:last] for r in rows]])
                held = []
            held.append([r[last:] for r in rows])
        if held:
            yield from ready(held)

    return run


def _verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of documents of which some texts have a Jaccard similarity of at least ``similarity``.

    Only the texts of documents in a pair are shuffled.
    """
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "paired")
    texts = cut(among(rows, ids).select("doc_id", "text"), "texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                if x == y:
                    fine.append(True)
                    continue
                p, q = shingle_set(x, words), shingle_set(y, words)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                fine.append(bool(shared >= similarity * (len(p) + len(q) - shared)))
            keep = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    out = cut(in_arrow(both, verify, "a long, b long"), "links")
    discard(ids, texts)
    return out


def similar_documents(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of the documents with an id: component_id is the smallest doc_id of their group.

    Groups are the components of all pairs with a Jaccard similarity of at least
    ``similarity`` of the sets of word shingles.  Texts without words are
    alike.  Of texts with equal sets only the first goes on, so copies are never expanded into pairs.

    The fingerprints' proposals join most of a group cheaply.  What they miss is
    found by the exact prefixes of the sets: pairs between different groups only,
    in two passes those that share most of the prefix, in the last all.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    prints = cut(_prints(rows, words), "prints")
    same = ["n", "s0", "s1"]
    classes = cut(prints.groupBy(*same).agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("f0", "f1", "f2", "keys"))), "classes")
    members = prints.select("doc_id", *same).join(classes.select(*same, "first"), same).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    wordless = rows.join(prints.select("doc_id"), "doc_id", "left_anti").select("doc_id")
    least = wordless.agg(F.min("doc_id").alias("b"))
    known = members.unionByName(wordless.join(F.broadcast(least)).select(F.col("doc_id").alias("a"), "b").where("a <> b"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    flat = classes.select(F.col("first").alias("doc_id"), "f0", "f1", "f2", F.explode("keys").alias("key"))
    proposed = in_arrow(flat.repartition(n, "key").sortWithinPartitions("key", "doc_id"), _propose, "a long, b long, bits int").where("a <> b")
    # at most one a bucket; the closest join a group with few texts compared, and whatever they leave apart the prefixes find
    closest = proposed.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "b"))), 1, CLOSEST).alias("x"))
    pairs = cut(closest.select("a", F.explode("x.b").alias("b")), "pairs")
    links = cut(known.unionByName(_verified(pairs, rows, words, similarity)), "links")
    # of equal sets one: the first document goes on, and every document that is the first of any of its texts
    copies = cut(members.select(F.col("a").alias("doc_id")).distinct().join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_anti"), "copies")
    discard(pairs, prints, classes)
    with freeing(spark):
        spread, *sources = _prefixes(among(rows, copies, how="left_anti"), words, similarity)
    shared = cut(in_arrow(spread.repartition(n, "key").sortWithinPartitions("key"), _several, _PREFIX), "prefixes")
    discard(*sources)
    # twice the pairs between groups that share most, then all that are left; groups that nothing joined are met by the same pairs
    roots, joined = connected_components(links), True
    for all_pairs in (False, False, True):
        if not joined and not all_pairs:
            continue
        placed = shared.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"), "at", *PARITIES)
        met = in_arrow(placed.repartition(n, "key").sortWithinPartitions("key", "at"), _across(similarity, all_pairs), "a long, b long")
        if all_pairs:
            pairs = cut(met.distinct(), "pairs")
        else:
            ranked = met.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")))
            pairs = cut(ranked.where(F.col("k") <= CLOSEST).select("a", "b"), "pairs")
        if pairs.isEmpty():  # no two groups share a prefix any more
            discard(pairs)
            break
        found = _verified(pairs, rows, words, similarity)
        joined = not found.isEmpty()
        if joined:
            # the groups so far are stars already: only they and what joins them are labelled anew
            stars, roots = roots, connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
            discard(stars)
        discard(pairs, found)
    discard(copies, shared, links)
    return rows.select("doc_id").distinct().join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays, and every row without doc_id."""
    gone = cut(similar_documents(docs).where("doc_id <> component_id").select("doc_id"), "gone")
    return among(docs, gone, how="left_anti").select(*docs.columns)
