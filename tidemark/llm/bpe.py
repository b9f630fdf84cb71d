"""Byte-level BPE encoding and decoding (operator 2).

A text is cut at the special tokens and then by the byte-level pre-tokenizer's
pattern.  Each distinct piece is merged once per worker: its symbols form a
doubly linked list, a priority queue holds the ranks of the mergeable pairs,
and an entry that no longer fits the symbols at its place is stale and is
skipped.  Decoding concatenates the vocabulary's strings and maps them to
bytes.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, in_arrow, keep, small_batches, table
from .mixing import in_mixture

#: Fixed value: how byte-level BPE cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers, and the length up to which it remembers one.
CACHED, CACHED_CHARS = 1 << 18, 64
_NONE: dict[int, int] = {}
SPECIAL_KEYS = ("single_word", "lstrip", "rstrip", "normalized")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class BytePairEncoding:
    """An encoder for a vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or not plain:
            raise ValueError(f"{path}: only a plain byte-level BPE is supported")
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab: dict[str, int] = model["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.byte_ids = [vocab[c] for c in byte_characters()]
        #: left -> right -> rank of the merge; the same by bytes; rank -> the merged symbol
        self.ranks: list[dict[int, int]] = [_NONE] * (max(vocab.values()) + 1)
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if self.ranks[a] is _NONE:
                self.ranks[a] = {}
            self.ranks[a][b] = rank
            self.made.append(vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")])
        pairs = {(x, y): r for x, a in enumerate(self.byte_ids) for y, b in enumerate(self.byte_ids) if (r := self.ranks[a].get(b)) is not None}
        self.byte_ranks = pairs.get
        self.special: dict[str, int] = {}
        for t in spec["added_tokens"]:
            if any(t[k] for k in SPECIAL_KEYS):
                raise ValueError(f"{path}: added token {t['content']!r} has options that are not supported")
            self.special[t["content"]] = t["id"]
            self.strings[t["id"]] = t["content"].encode()
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        #: What is remembered, and what was before the last time that this was full.
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = list(map(self.byte_ids.__getitem__, piece))
        n, ranks, made = len(ids), self.ranks, self.made
        queue = [r * n + i for i, r in enumerate(map(self.byte_ranks, zip(piece, piece[1:]))) if r is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            a, j = ids[i], after[i]
            if a < 0 or j >= n or ranks[a].get(ids[j]) != rank:
                continue  # stale: one of the two symbols has been merged since
            ids[i] = new = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks[new].get(ids[k])) is not None:
                    heappush(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := ranks[ids[h]].get(new)) is not None:
                heappush(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.split(text) if any(t in text for t in self.special) else [text]:
            if part in self.special:
                out.append(packed([self.special[part]]))
                continue
            pieces = self.find(part)
            ids = list(map(self.pieces.get, pieces))
            if None in ids:
                ids = [self.new(p) if x is None else x for p, x in zip(pieces, ids)]
            out += ids
        return b"".join(out)

    def new(self, piece: str) -> bytes:
        """The packed ids of a piece that is not remembered, or was before."""
        ids = self.old_pieces.get(piece)
        if ids is None:
            ids = packed(self.merge(piece.encode()))
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: list[int] | array) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD, ids out of the vocabulary nothing."""
        strings = self.strings
        return b"".join([strings.get(i, b"") for i in ids]).decode("utf-8", "replace")


def encoder(path: str) -> BytePairEncoding:
    """The encoder of a file, which the worker keeps."""
    return keep(f"bpe {path}", lambda: BytePairEncoding(path))


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpacked(ids: bytes) -> array:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a


def vocabulary() -> str:
    """The place of the 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` but ``text``, with n_tokens, ids_sha256 and decoded_sha256 (and the ids, and the decoded text).

    Null texts count as empty: no ids, and the digests of nothing.  The ids of
    a text are one array, however long it is.  Columns named like the new ones
    are replaced.  The vocabulary is read on the executors at ``path``.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
    whole = fresh(docs, "_text")
    kept = docs.select(*[c for c in docs.columns if c not in (text, *new)], F.col(text).alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop(whole).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1).to_pylist():
                ids = bpe.encode(t or "")
                decoded = bpe.decode(unpacked(ids))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), unpacked(ids), decoded)[: len(new)])
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(new))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*b.schema.names[:-1], *new])

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return in_arrow(kept, run, f"{schema}, {added}".lstrip(", "), f"bpe {path}")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: every document with its token count and digests instead of its text, its slot and place in the mixture, in their order."""
    return in_mixture(encode(docs))
