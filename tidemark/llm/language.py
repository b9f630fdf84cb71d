"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton is built over labelled text.  A text is
parsed greedily into the longest phrases that occur in a language's text; a
language that needs n phrases for m bytes, with N bytes of labelled
text, has cross-parsing entropy n * log2(N) / m bits per byte.  The
language with the fewest normalised phrases wins.

Characters are taken as their bytes in UTF-8, so that any alphabet, however
large, has at most 256 symbols.  The automata are fitted on a bounded sample of
labelled rows (``TRAIN_CHARS`` per language); every text is parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import fresh, in_arrow, small_batches, table

UNKNOWN = "und"
#: Characters of labelled text per language that an automaton is built from, of one row of it, and of all languages together.
TRAIN_CHARS, ROW_CHARS, ALL_CHARS = 60_000, 600, 1_200_000
#: Texts that are parsed side by side, under how many a plain loop is faster, and symbols per block.
LANES, FEW, STEPS = 1024, 10, 64
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text in lower case, all between its letters one blank: digits, marks and markup say nothing of the language."""
    return _NO_LETTERS.sub(" ", text.lower())


class SuffixAutomaton:
    """All substrings of a sequence of symbols 1 .. k; state 0 is the start, 0 in ``table`` is no transition."""

    def __init__(self, symbols: list[int], k: int) -> None:
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size, self.states, self.symbols = len(symbols), len(nexts), k
        n = np.fromiter(map(len, nexts), np.int64, len(nexts))
        #: Transitions: from ``state`` by ``symbol`` to ``target``.
        self.state = np.repeat(np.arange(len(nexts), dtype=np.int32), n)
        self.symbol = np.fromiter((c for m in nexts for c in m), np.uint16, int(n.sum()))
        self.target = np.fromiter((t for m in nexts for t in m.values()), np.int32, int(n.sum()))

    @property
    def table(self) -> np.ndarray:
        """(states, k + 1) targets."""
        out = np.zeros((self.states, self.symbols + 1), np.int32)
        out[self.state, self.symbol] = self.target
        return out


class LanguageModel:
    """Automata of several languages over one alphabet.

    Their transitions are some MB and are what is sent to workers; each worker makes of them, once, the table that it parses by.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        data = {lang: letters(t).encode("utf-8", "surrogatepass") for lang, t in texts.items()}
        known = sorted(set().union(*data.values()))
        #: byte -> symbol; 0 for all that no labelled text holds
        self.lookup = np.zeros(256, np.uint8)
        self.lookup[known] = np.arange(1, len(known) + 1)
        self.languages = sorted(texts)
        self.sizes = np.array([max(2, len(data[x])) for x in self.languages], float)
        self.parts = [SuffixAutomaton(self.lookup[np.frombuffer(data[x], np.uint8)].tolist(), len(known)) for x in self.languages]
        #: The last symbol pads texts that are over: it changes nothing.
        self.pad = len(known) + 1
        self.rows = np.cumsum([0, *(p.states for p in self.parts)])
        self.kind = np.int32 if int(self.rows[-1]) * (self.pad + 1) * 4 < 1 << 31 else np.int64
        self.base = (self.rows[:-1] * (self.pad + 1)).astype(self.kind)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @cached_property
    def table(self) -> np.ndarray:
        """The automata below one another, completed: per state and symbol the place of the row to go on from (after a
        missing transition that of the symbol from the start, or the start), times four, plus the phrases that end or stand alone."""
        width, k = self.pad + 1, self.pad
        out = np.empty(int(self.rows[-1]) * width, self.kind)
        for p, first in zip(self.parts, self.rows[:-1].tolist()):
            view = out[first * width : (first + p.states) * width].reshape(p.states, width)
            start = np.zeros(k, np.int64)
            start[p.symbol[p.state == 0]] = p.target[p.state == 0]
            alone, go = start == 0, (start + first) * width << 2
            view[:, :k] = go | 1 + alone
            view[0, :k] = go | alone
            view[p.state, p.symbol] = (p.target.astype(np.int64) + first) * width << 2
            view[:, k] = np.arange(first, first + p.states) * width << 2
        return out

    def symbols(self, text: str) -> np.ndarray:
        return self.lookup[np.frombuffer(letters(text).encode("utf-8", "surrogatepass"), np.uint8)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) numbers of phrases of the greedy parses; a byte without a match is a phrase of its own."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not self.languages:
            return out
        rows = [self.symbols(t) for t in texts]
        self.parsed = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-self.parsed, kind="stable").tolist()
        for first in range(0, len(order), LANES):
            ids = order[first : first + LANES]
            self._parse([rows[i] for i in ids], ids, out)
        return out

    def _parse(self, rows: list[np.ndarray], ids: list[int], out: np.ndarray) -> None:
        """Parses rows, longest first, side by side: one step takes a symbol of each row that is not over, in each language."""
        n, table, base, pad = len(rows), self.table, self.base, self.pad
        lengths = np.array([len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(STEPS, np.uint8)]) if n else np.zeros(0, np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.tile(base, (n, 1))
        count = np.zeros((n, len(base)), np.int64)
        at = 0
        while (active := int(np.searchsorted(-lengths, -at))) >= FEW:
            columns = at + np.arange(STEPS)
            block = np.where(columns < lengths[:active, None], flat[np.minimum(starts[:active, None] + columns, len(flat) - 1)], pad).astype(table.dtype)
            block = np.ascontiguousarray(block.T)[:, :, None]
            s, c = state[:active], count[:active]
            for x in block:
                t = table[s + x]
                c += t & 3
                s = t >> 2
            state[:active] = s
            at += STEPS
        view = memoryview(table)
        for i in range(active):
            rest = rows[i][at:].tolist()
            for k in range(len(base)):
                s, c = int(state[i, k]), 0
                for x in rest:
                    t = view[s + x]
                    c += t & 3
                    s = t >> 2
                state[i, k] = s
                count[i, k] += c
        out[ids] = count + (state != base)

    def bits(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) cross-parsing entropies in bits per byte."""
        phrases = self.phrases(texts)
        return phrases * np.log2(self.sizes) / np.maximum(self.parsed, 1)[:, None]


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame) -> LanguageModel:
    """Learns from text and non-null lang of the rows that are not held out.

    Bounded sample: pieces of ``ROW_CHARS`` characters, from a hashed place of
    the text, of as many rows per language, in order of a hash of doc_id, as fill
    ``TRAIN_CHARS`` (or a language's part of ``ALL_CHARS``, if there are many).
    Every language that has a labelled row is learned.  The pick is one
    map-side top-k per language.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names = [r["lang"] for r in labelled.select("lang").distinct().collect()]  # one row per language
    if not names:
        return LanguageModel({})
    wanted = max(ROW_CHARS, min(TRAIN_CHARS, ALL_CHARS // len(names)))
    rows = wanted // ROW_CHARS * 3
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.char_length("text") - ROW_CHARS, F.lit(0)) + 1).cast("int") + 1
    labelled = labelled.select("lang", F.substring(F.col("text"), place, F.lit(ROW_CHARS)).alias("text"), F.xxhash64("doc_id").alias("h"))
    # a row is picked if its hash is among the smallest of its part; parts keep a hot language from being one task
    parts = 32
    w = Window.partitionBy("lang", "part").orderBy("h", "text")
    some = labelled.withColumn("part", F.pmod(F.col("h"), F.lit(parts))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= -(-rows // parts) * 2)
    picked: dict[str, list[tuple[int, str]]] = {}
    for r in some.select("lang", "h", "text").collect():
        picked.setdefault(r["lang"], []).append((r["h"], r["text"]))
    texts = {}
    for lang, found in picked.items():
        seen, parts_of, total = set(), [], 0
        for _, t in sorted(found):
            if t in seen:
                continue
            seen.add(t)
            parts_of.append(t)
            total += len(t) + 1
            if total >= wanted:
                break
        texts[lang] = "\n".join(parts_of)
    return LanguageModel(texts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, with lang_pred, score (0 to 1) and lang_bits.

    A text that is null or has no letter is ``und`` with score 0, as is any
    text if nothing was learned.  The score is the share of the winner among
    2^-bits of all languages.  Ties go to the first language in order of name.
    """
    spark = docs.sparkSession
    small_batches(spark, LANES)
    shared = spark.sparkContext.broadcast(model)  # some MB per language at most: bounded by TRAIN_CHARS and ALL_CHARS
    whole = fresh(docs, "_text")
    kept = docs.select(*[c for c in docs.columns if c not in (text, "lang_pred", "score", "lang_bits")], F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop(whole).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            pred, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if some and m.languages:
                for i, row in zip(some, m.bits([texts[i] for i in some])):
                    k = int(row.argmin())
                    pred[i], bits[i] = m.languages[k], float(row[k])
                    score[i] = float(1 / np.exp2(np.minimum(row[k] - row, 0) * min(len(texts[i]), 100)).sum())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score", "lang_bits"])

    return in_arrow(kept, run, f"{schema}, lang_pred string, score double, lang_bits double".lstrip(", "))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; those that are ``und`` go: a null text, or one without a letter.

    The columns stay as they are; a null ``lang`` becomes the predicted one.
    """
    names = {c: fresh(docs, f"_{c}") for c in ("lang_pred", "score", "lang_bits") if c in docs.columns}
    text = fresh(docs, "_whole")
    found = identify(docs.withColumnsRenamed(names).withColumn(text, F.col("text")), fit(docs), text)
    kept = found.where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.drop("lang_pred", "score", "lang_bits").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)
