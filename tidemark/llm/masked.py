"""Language-model scores by masked pseudo-likelihood (operator 5).

Every word of a text is predicted from both sides: the sum of log P(word | both
sides) over all words scores the text.  Words are the runs of bytes between
white space of the lower-cased text in UTF-8.  P has three parts:

* A window network, trained in numpy: the classes of the two words on either
  side, embedded by place, pass through a hyperbolic tangent into a softmax over
  classes.  A class is one of the frequent words, or all other words that begin
  with a byte of the same group.
* Within a class of other words, a word has its share of a byte-bigram model of
  the corpus, divided by the share of the whole class.  So ``base``, the product
  of both, adds up to one over all words there can be.
* A memory of the corpus: in how many documents a word stands between the same
  two words.  With c of T such places in other documents, the probability is
  (c + STRENGTH * base) / (T + STRENGTH), which adds up to one as well.  Places
  between two frequent words are left to the network.  A document that is scored
  by the corpus that it belongs to never counts for itself.

Everything learned comes from all texts, and is a function of the rows, not of
their partitions.  Documents are dealt by a hash to blocks of some million
characters, one row of a table each.  The network is trained by rounds: in each,
every block of the round trains a copy from the same start, and the next start
is the mean of the copies by their words.  The memory grows with the corpus and
is never held whole: blocks send their sorted keys in pieces to shards, which
add them up and send the totals back to the blocks that asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import cut, discard, fresh, in_arrow, small_batches, table

#: Frequent words with a class of their own, and groups of the first bytes of all others.
FREQUENT, GROUPS = 63, 64
#: Classes: padding, then frequent words, then groups.
CLASSES = 1 + FREQUENT + GROUPS
#: Neighbours on each side; width of the network; words of a training step; rounds of training.
SIDE, WIDTH, STEP, ROUNDS = 2, 16, 4096, 2
RATE, CLIP, SEED = 0.15, 5.0, 11
#: What the base weighs against the places of the memory.
STRENGTH = 1.0
#: Characters of a block: at least, at most, and how many blocks there should be at least before they get larger.
BLOCK_CHARS, MOST_CHARS, BLOCKS = 1 << 22, 1 << 26, 1000
#: Keys (about) of a shard of the memory.
SHARD_KEYS = 1 << 19
#: Words of a chunk that may become frequent ones, and the most bytes that such a word may have.
CANDIDATES, SHORT = 200, 14
#: Bytes that are looked at together, and bits of a key: a word's, and beside the shard's number a context's.
CHUNK, WORD_BITS, CONTEXT_BITS = 1 << 22, 16, 32
#: Bytes whose places, hashes and bigrams are made at once.
PIECE = 1 << 18
_END, _BYTES = 256, 64
_SPACES = [9, 10, 11, 12, 13, 32]


@lru_cache(maxsize=1)
def _tabulation() -> np.ndarray:
    """Random 64-bit numbers by place in a word (repeating) and byte: their sum is a word's hash."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (_BYTES, 256), np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


class Words:
    """The words of texts laid end to end: bytes, where words begin in them, hashes, and the place of each word's text."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        space = _is_space()[data]
        lengths = np.array([len(t) for t in texts], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        self.sizes = end - begin
        self.bytes = data[~space]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hash = self.sizes.astype(np.uint64)
        # some words at a time: what is made for each byte takes many times the byte
        for i, j in self.pieces():
            own, at = self.bytes[self.starts[i] : self.starts[j - 1] + self.sizes[j - 1]], self.starts[i:j] - self.starts[i]
            inside = np.arange(len(own)) - np.repeat(at, self.sizes[i:j])
            self.hash[i:j] += np.add.reduceat(_tabulation()[inside % _BYTES, own], at)
        firsts = np.cumsum(lengths + 1) - lengths - 1
        self.text = np.searchsorted(firsts, begin, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))

    def pieces(self) -> Iterator[tuple[int, int]]:
        """(first, end) of runs of words of about ``PIECE`` bytes, a longer word on its own."""
        i = 0
        while i < len(self.sizes):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + PIECE)))
            yield i, j
            i = j

    def spelled(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def around(self, values: np.ndarray, d: int, beyond: int) -> np.ndarray:
        """The value of the word d places on, ``beyond`` past the ends of the text."""
        n, out = len(values), np.full(len(values), beyond, values.dtype)
        a, z = (slice(max(-d, 0), n - max(d, 0)), slice(max(d, 0), n - max(-d, 0)))
        same = self.text[a] == self.text[z]
        out[a] = np.where(same, values[z], out[a])
        return out


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[_SPACES] = True
    return out


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def _ones() -> np.ndarray:
    return np.ones(CLASSES, np.float32)


class Network:
    """The bidirectional window network; ``used`` tells which classes there are."""

    def __init__(self, vector: np.ndarray | None = None, used: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(SEED)
        e, u = 2 * SIDE * CLASSES * WIDTH, WIDTH * CLASSES
        if vector is None:
            vector = np.concatenate([rng.normal(0, 0.3, e), rng.normal(0, 0.3, u), np.zeros(CLASSES)])
        vector = vector.astype(np.float32)
        self.embed = vector[:e].reshape(2 * SIDE, CLASSES, WIDTH)
        self.out = vector[e : e + u].reshape(WIDTH, CLASSES)
        self.bias = vector[e + u :]
        self.off = np.float32(-1e9) * ~(np.arange(CLASSES) > 0 if used is None else used)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.out.ravel(), self.bias])

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        hidden = self.embed[0].take(around[0], 0)
        for i in range(1, 2 * SIDE):
            hidden += self.embed[i].take(around[i], 0)
        return np.tanh(hidden, out=hidden)

    def _logits(self, hidden: np.ndarray) -> np.ndarray:
        """Logits of the classes, less the largest of a row only where their powers might be too large or too small for a float."""
        logits = hidden @ self.out
        logits += self.bias + self.off
        if (np.abs(self.out).sum(0) + np.abs(self.bias)).max() > 60:  # hidden layers are from -1 to 1
            logits -= logits.max(1, keepdims=True)
        return logits

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layers and log-probabilities of the classes for windows (2 * SIDE, n) of neighbours."""
        hidden = self._hidden(around)
        logits = self._logits(hidden)
        logits -= np.log(np.exp(logits) @ _ones())[:, None]
        return hidden, logits

    def of(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of the target's class alone."""
        logits = self._logits(self._hidden(around))
        own = logits[np.arange(len(target)), target]
        return own - np.log(np.exp(logits, out=logits) @ _ones())

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        """One step of gradient descent on the mean negative log-probability of the targets."""
        n = len(target)
        hidden = self._hidden(around)
        gap = self._logits(hidden)
        np.exp(gap, out=gap)
        gap *= (1 / (gap @ _ones()))[:, None]
        gap[np.arange(n), target] -= 1
        back = (gap @ self.out.T) * (1 - hidden * hidden)
        rate = np.float32(RATE)
        self.out -= rate * np.clip(hidden.T @ gap / np.float32(n) * WIDTH, -CLIP, CLIP)
        self.bias -= rate * (np.ones(n, np.float32) @ gap) / np.float32(n) * WIDTH
        back = back.astype(np.float64)
        for i in range(2 * SIDE):
            # sums over runs of equal classes, which a radix sort puts together
            order = np.argsort(around[i].astype(np.uint8), kind="stable")
            count = np.bincount(around[i], minlength=CLASSES)
            some = np.flatnonzero(count)
            total = np.add.reduceat(back[order], (np.cumsum(count) - count)[some], axis=0)
            # each neighbour's embedding moves by its mean gradient in the step
            self.embed[i][some] -= rate * (total / (count[some, None] + 8)).astype(np.float32)


class MaskedModel:
    """Frequent words, byte bigrams and the network; ``corpus`` holds the blocks that it was learned from."""

    def __init__(self, frequent: list[bytes], bigrams: np.ndarray, vector: np.ndarray | None = None) -> None:
        self.vector = vector
        hashes = Words(frequent).hash if frequent else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.class_of = hashes[order], 1 + order
        share = bigrams.astype(float) + 0.5
        share[:, _SPACES] = 0
        share[_END, _END] = 0  # no word is empty
        with np.errstate(divide="ignore"):
            self.bytes = np.log(share / share.sum(1, keepdims=True))
        # the share of each group of first bytes, without that of the frequent words in it
        group = np.arange(256) % GROUPS
        mass = np.bincount(group, np.exp(self.bytes[_END, :256]), GROUPS)
        if frequent:
            w = Words(frequent)
            np.subtract.at(mass, group[w.bytes[w.starts]], np.exp(self.spelled(w)))
        self.mass = np.log(np.maximum(mass, 1e-300))
        self.used = np.zeros(CLASSES, bool)
        self.used[1 : 1 + len(frequent)] = True
        self.used[1 + FREQUENT :] = mass > 1e-12
        self.corpus: DataFrame | None = None

    def spelled(self, w: Words) -> np.ndarray:
        """Log-probability of each word by the byte bigrams, its end included."""
        if not len(w.sizes):
            return np.zeros(0)
        out = self.bytes[w.bytes[w.starts + w.sizes - 1], _END]
        for i, j in w.pieces():
            own, at = w.bytes[w.starts[i] : w.starts[j - 1] + w.sizes[j - 1]], w.starts[i:j] - w.starts[i]
            before = np.concatenate([[_END], own[:-1]]).astype(np.int64)
            before[at] = _END
            out[i:j] += np.add.reduceat(self.bytes[before, own], at)
        return out

    def classes(self, w: Words) -> np.ndarray:
        out = 1 + FREQUENT + (w.bytes[w.starts] % GROUPS).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == w.hash, self.class_of[at], out)
        return out

    def windows(self, w: Words, classes: np.ndarray) -> np.ndarray:
        """(2 * SIDE, n) classes of the neighbours of each word; 0 beyond the ends of its text."""
        return np.stack([w.around(classes, d, 0) for d in [*range(-SIDE, 0), *range(1, SIDE + 1)]])

    def base(self, w: Words) -> np.ndarray:
        """Log-probability of each word by network and bytes."""
        net = Network(self.vector, self.used)
        classes = self.classes(w)
        around = self.windows(w, classes)
        out = np.zeros(len(classes))
        for i in range(0, len(classes), STEP):
            out[i : i + STEP] = net.of(around[:, i : i + STEP], classes[i : i + STEP])
        other = classes > FREQUENT
        return out + np.where(other, self.spelled(w) - self.mass[np.maximum(classes - 1 - FREQUENT, 0)], 0)

    def keys(self, w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(which, key): the words that are not between two frequent ones, and their keys: CONTEXT_BITS + bits of the neighbours' hash, then the word's."""
        frequent = self.classes(w) <= FREQUENT
        which = np.flatnonzero(~(w.around(frequent, -1, 1) & w.around(frequent, 1, 1)))
        left, right = w.around(w.hash, -1, 0)[which], w.around(w.hash, 1, 0)[which]
        context = _mixed(_mixed(left + np.uint64(1)) + right) >> np.uint64(64 - CONTEXT_BITS - bits)
        return which, context << np.uint64(WORD_BITS) | _mixed(w.hash[which]) >> np.uint64(64 - WORD_BITS)


def pack(docs: DataFrame, text: str = "text", prepare: Callable[[str | None], bytes] = lowered) -> DataFrame:
    """(block, rows, sizes, data): the documents in blocks, by a hash of id and text; ``rows`` holds all columns but ``text``, ``data`` the packed texts as ``prepare`` makes them."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.char_length(text))).first()[0] or 0
    blocks = max(1, -(-total // max(BLOCK_CHARS, min(MOST_CHARS, total // BLOCKS))))
    keep = [c for c in docs.columns if c != text]
    # rows without an id may be as many as they like, with equal texts too: they are dealt by place
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()) if "doc_id" in keep else F.monotonically_increasing_id()
    h = F.xxhash64(*(["doc_id"] if "doc_id" in keep else []), F.col(text), salt)
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(text, F.lit("")).alias("text"), h.alias("h"))
    n = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = rows.withColumn("block", F.pmod("h", F.lit(blocks))).repartition(n, "block").sortWithinPartitions("block", "h")
    schema = StructType([StructField("block", LongType()), StructField("rows", ArrayType(rows.schema["row"].dataType)), StructField("sizes", ArrayType(IntegerType())), StructField("data", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, texts = None, [], []

        def done() -> pa.RecordBatch:
            whole = pa.concat_arrays(held)
            sizes = pa.array([len(t) for t in texts], pa.int32())
            offsets = pa.array([0, len(whole)], pa.int32())
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.ListArray.from_arrays(offsets, whole), pa.ListArray.from_arrays(offsets, sizes), pa.array([data], pa.binary())], ["block", "rows", "sizes", "data"])

        for b in batches:
            block = b.column("block").to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=-1)) if b.num_rows else np.zeros(0, int)
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                if held and block[a] != now:
                    yield done()
                    held, texts = [], []
                now = int(block[a])
                part = b.slice(a, z - a)
                held.append(part.column("row"))
                texts += [prepare(t) for t in part.column("text").to_pylist()]
        if held:
            yield done()

    return cut(in_arrow(dealt, run, schema), "blocks")


def packed_texts(sizes: pa.ListScalar, data: pa.BinaryScalar) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of a block, about ``CHUNK`` bytes at a time."""
    plain = zstandard.ZstdDecompressor().decompress(data.as_py())
    at, first, out, n = 0, 0, [], 0
    for size in sizes.as_py():
        out.append(plain[at : at + size])
        at, n = at + size, n + size
        if n >= CHUNK:
            yield first, out
            first, out, n = first + len(out), [], 0
    if out:
        yield first, out


def _statistics(packed: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, and how often each byte follows each (256: begin or end of a word).

    A frequent word has at most ``SHORT`` bytes and is among the ``CANDIDATES``
    most frequent of at least one chunk, where its spelling is noted (in two numbers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams, side = np.zeros(257 * 257, np.int64), 257

        def rows(pair: bool, key: np.ndarray, n: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pair] * len(key), pa.bool_()), *map(pa.array, (key, n, a, z))], ["pair", "key", "n", "a", "z"])

        for b in batches:
            for i in range(b.num_rows):
                for _, texts in packed_texts(b.column(0)[i], b.column(1)[i]):
                    w = Words(texts)
                    if not len(w.hash):
                        continue
                    for first, end in w.pieces():
                        own, at = w.bytes[w.starts[first] : w.starts[end - 1] + w.sizes[end - 1]], w.starts[first:end] - w.starts[first]
                        before = np.concatenate([[_END], own[:-1]]).astype(np.int64)
                        before[at] = _END
                        bigrams += np.bincount(before * side + own, minlength=side * side)
                    bigrams += np.bincount(w.bytes[w.starts + w.sizes - 1].astype(np.int64) * side + _END, minlength=side * side)
                    found, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                    head, tail = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                    for j in np.argsort(-n, kind="stable")[:CANDIDATES].tolist():
                        if w.sizes[at[j]] <= SHORT:
                            word = w.spelled(int(at[j])).ljust(SHORT, b"\0")
                            head[j], tail[j] = (int.from_bytes(x, "big") for x in (word[: SHORT // 2], word[SHORT // 2 :]))
                    yield rows(False, found.view(np.int64), n, head, tail)
        at = np.flatnonzero(bigrams)
        yield rows(True, at, bigrams[at], at * 0, at * 0)

    counted = packed.select("sizes", "data").mapInArrow(run, "pair boolean, key long, n long, a long, z long")
    totals = cut(counted.groupBy("pair", "key").agg(F.sum("n").alias("n"), F.max("a").alias("a"), F.max("z").alias("z")), "words")
    bigrams = np.zeros(257 * 257, np.int64)
    for k, n in totals.where("pair").select("key", "n").collect():  # at most 257 * 257 rows
        bigrams[k] = n
    best = totals.where("not pair and a > 0").orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    discard(totals)
    return [(r["a"].to_bytes(SHORT // 2, "big") + r["z"].to_bytes(SHORT // 2, "big")).rstrip(b"\0") for r in best], bigrams.reshape(257, 257)


def fit_blocks(packed: DataFrame) -> MaskedModel:
    """Learns from all blocks; without any word all words are alike."""
    model = MaskedModel(*_statistics(packed))
    model.vector = Network().vector().astype(np.float64)
    for turn in range(ROUNDS):
        frozen = packed.sparkSession.sparkContext.broadcast(model)  # some hundred kB, of a fixed size

        def run(batches: Iterator[pa.RecordBatch], frozen=frozen) -> Iterator[pa.RecordBatch]:
            m, total, seen = frozen.value, 0.0, 0
            for b in batches:
                for i in range(b.num_rows):
                    net, own = Network(m.vector, m.used), 0
                    for _, texts in packed_texts(b.column(0)[i], b.column(1)[i]):
                        w = Words(texts)
                        classes = m.classes(w)
                        around = m.windows(w, classes)
                        for j in range(0, len(classes), STEP):
                            net.train(around[:, j : j + STEP], classes[j : j + STEP])
                        own += len(classes)
                    total, seen = total + net.vector().astype(np.float64) * own, seen + own
            if seen:
                v = np.asarray(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v), pa.array(np.full(len(v), seen))], ["i", "v", "n"])

        part = packed.where(F.pmod("block", F.lit(ROUNDS)) == turn).select("sizes", "data")
        vector = model.vector.copy()
        for i, v in part.mapInArrow(run, "i int, v double, n long").groupBy("i").agg(F.sum("v") / F.sum("n")).collect():  # one row per weight
            vector[i] = v
        model.vector = vector
        frozen.unpersist()
    # sums of other orders differ by rounding only, which is taken away here
    model.vector = np.round(model.vector, 6)
    return model


def fit(docs: DataFrame, text: str = "text") -> MaskedModel:
    """A model of all texts of ``docs``, for scores of other documents."""
    packed = pack(docs, text)
    model = fit_blocks(packed)
    model.corpus = packed
    return model


def _own_keys(m: MaskedModel, sizes: pa.ListScalar, data: pa.BinaryScalar, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(keys, documents, places, chunks) of a block: the distinct keys ascending, in how many documents each is, and of all keys which of these they are; per chunk its words, and for each key of a word in which document."""
    chunks, all_keys, all_docs = [], [], []
    for first, texts in packed_texts(sizes, data):
        w = Words(texts)
        which, key = m.keys(w, bits) if len(w.hash) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        chunks.append((first, w, which, key))
        all_keys.append(key)
        all_docs.append(w.text[which] + first)
    key, doc = np.concatenate([np.zeros(0, np.uint64), *all_keys]), np.concatenate([np.zeros(0, np.int64), *all_docs])
    order = np.argsort(key, kind="stable")  # documents ascend within a key
    key, doc = key[order], doc[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    new = head.copy()
    new[1:] |= doc[1:] != doc[:-1]
    group = np.cumsum(head, dtype=np.int32) - np.int32(1)
    places = np.empty(len(key), np.int32)
    places[order] = group
    return key[head], np.bincount(group[new]).astype(np.uint32), places, chunks


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _whole(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pressed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def unpressed(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4")


def _asked(packed: DataFrame, frozen, bits: int, counts: bool, answers: bool) -> DataFrame:
    """(shard, block, counts, answers, keys, documents): the keys of each block by shard; whether they count, and whether totals are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        for b in batches:
            for i in range(b.num_rows):
                distinct, count, *_ = _own_keys(m, b.column(1)[i], b.column(2)[i], bits)
                shard = (distinct >> np.uint64(CONTEXT_BITS + WORD_BITS)).astype(np.int64)
                starts = np.flatnonzero(np.diff(shard, prepend=-1)) if len(shard) else np.zeros(0, int)
                ends = np.append(starts[1:], len(shard))
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), pa.array(np.full(n, b.column(0)[i].as_py(), np.int64)), pa.array([counts] * n, pa.bool_()), pa.array([answers] * n, pa.bool_()), pa.array([_six(distinct[a:z]) for a, z in zip(starts, ends)], pa.binary()), pa.array([pressed(count[a:z]) for a, z in zip(starts, ends)], pa.binary())], ["shard", "block", "counts", "answers", "keys", "documents"])

    return packed.select("block", "sizes", "data").mapInArrow(run, "shard int, block long, counts boolean, answers boolean, keys binary, documents binary")


def _totals(asked: DataFrame) -> DataFrame:
    """(block, shard, totals): for each key of a block in how many documents it is, and all keys of its context."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, keys, counts = [], [], []
        for b in batches:
            for i in range(b.num_rows):
                keys.append(_whole(b.column("keys")[i].as_py()))
                # who only asks counts for nothing
                counts.append(unpressed(b.column("documents")[i].as_py()) if b.column("counts")[i].as_py() else np.zeros(len(keys[-1]), "<u4"))
                wanted.append(b.column("block")[i].as_py() if b.column("answers")[i].as_py() else None)
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        k, n = k[order], np.concatenate(counts)[order]
        totals = np.empty((2, len(k)), np.int64)
        for row, x in zip(totals, (k, k >> np.uint64(WORD_BITS))):
            head = np.ones(len(x), bool)
            head[1:] = x[1:] != x[:-1]
            group = np.cumsum(head) - 1
            row[order] = np.bincount(group, n)[group]
        end = 0
        for block, own in zip(wanted, keys):
            end += len(own)
            if block is not None:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([key[0].as_py()], pa.int32()), pa.array([pressed(totals[:, end - len(own) : end].ravel())], pa.binary())], ["block", "shard", "totals"])

    return asked.groupBy("shard").applyInArrow(run, "block long, shard int, totals binary")


def score_blocks(packed: DataFrame, model: MaskedModel, corpus: DataFrame | None) -> DataFrame:
    """The rows of ``packed`` with n_words, log_likelihood and per_word; ``corpus`` None: they are the corpus, and each is left out of its own score."""
    spark = packed.sparkSession
    inside = corpus is None
    held, model.corpus = model.corpus, None
    frozen = spark.sparkContext.broadcast(model)  # some hundred kB, of a fixed size
    model.corpus = held
    words = (packed if inside else corpus).agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, (words // 6 // SHARD_KEYS).bit_length())
    asked = _asked(packed, frozen, bits, inside, True)
    if not inside:
        asked = asked.unionByName(_asked(corpus, frozen, bits, True, False))
    totals = _totals(asked).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("found"))
    both = packed.hint("merge").join(totals.withColumnRenamed("block", "b"), F.col("block") == F.col("b"), "left").select("rows", "sizes", "data", "found")
    row = packed.schema["rows"].dataType.elementType
    new = ("n_words", "log_likelihood", "per_word")
    kept = [f for f in row.fields if f.name not in new]
    schema = StructType([*kept, StructField(new[0], LongType()), *StructType.fromDDL(f"{new[1]} double, {new[2]} double").fields])
    from_own = 1 if inside else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column(0)[i].values
                _, _, places_of, chunks = _own_keys(m, b.column(1)[i], b.column(2)[i], bits)
                parts = [unpressed(x["totals"]) for x in b.column(3)[i].as_py() or []]
                d = np.concatenate([np.zeros(0), *(p[: len(p) // 2] for p in parts)])
                t = np.concatenate([np.zeros(0), *(p[len(p) // 2 :] for p in parts)])
                n, total, done = np.zeros(len(rows), np.int64), np.zeros(len(rows)), 0
                for first, w, which, key in chunks:
                    if not len(w.hash):
                        continue
                    logp = m.base(w)
                    at, done = places_of[done : done + len(key)], done + len(key)
                    # the document itself stands once in its keys' counts, and with each of its words in a context in those of the context
                    context = key >> np.uint64(WORD_BITS)
                    order = np.lexsort((key, w.text[which]))  # a context is the beginning of its keys
                    k, doc = key[order], w.text[which][order]
                    fresh_key = np.ones(len(k), bool)
                    fresh_key[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
                    fresh_context = np.ones(len(k), bool)
                    fresh_context[1:] = (context[order][1:] != context[order][:-1]) | (doc[1:] != doc[:-1])
                    own = np.zeros(len(k))
                    if len(k):
                        group = np.cumsum(fresh_context) - 1
                        own[order] = np.bincount(group, fresh_key)[group]
                    others, places = d[at] - from_own, t[at] - from_own * own
                    some = np.flatnonzero(places > 0)
                    x = which[some]
                    logp[x] = np.log(others[some] + STRENGTH * np.exp(logp[x])) - np.log(places[some] + STRENGTH)
                    last = first + len(w.counts)
                    n[first:last] = w.counts
                    total[first:last] = np.bincount(w.text, logp, len(w.counts))
                per = pa.array(total / np.maximum(n, 1), mask=n == 0)
                columns = [rows.field(row.fieldNames().index(f.name)) for f in kept]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(total), per], [*(f.name for f in kept), *new])
                yield out

    return both.mapInArrow(run, schema)


def score(docs: DataFrame, model: MaskedModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, with n_words, log_likelihood and per_word, by the model of another corpus.

    A text without words (null and empty ones too) has log-likelihood 0 and a null per_word.
    Columns named like the new ones are replaced.
    """
    return score_blocks(pack(docs, text), model, model.corpus)


def score_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """As ``score``, of every document by a model of all of them, its own places left out of the memory."""
    packed = pack(docs, text)
    return score_blocks(packed, fit_blocks(packed), None)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word of every document."""
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
