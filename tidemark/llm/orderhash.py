"""Order MinHash document fingerprints (operator 9, native).

A text's words are its runs without white space of at most ``PIECE`` characters.
A longer run is cut where its own characters say so (after one of ``ENDS``, four
characters on at least), so an edit moves the cuts near it only; a character of a
script that is written without spaces is a word.  ``K`` words form a k-mer.  Each k-mer is numbered by occurrence,
and k-mer and number are hashed together, once: the high bits of the hash
choose one of ``SKETCHES`` sketches and the hash itself ranks the k-mers of a
sketch (one permutation, cut into as many parts as there are sketches).  Every
sketch takes its ``TUPLE`` smallest, puts them back in text order and hashes
their k-mers as a tuple.  Reordering or editing a text changes tuples where
its set of words would not change.

The likeness of two fingerprints is the share of equal sketches among those
that either has; two fingerprints without any are alike.

All is done with DataFrame functions, on one array of longs per text: a hash
in the high 40 bits and a place in the low 24, so that one sort brings equal
k-mers together in text order.  So hashes are compared by 40 bits, and in a text of
over 16,777,216 words places start again from 0.  Texts are shuffled once, by a range
of doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import let, table
from .ordering import ranges

K, PIECE, SKETCHES, TUPLE = 3, 16, 32, 2
#: A sketch without k-mers, and the digits of one with some.
NONE, DIGITS = "-" * 8, 8
#: Characters of scripts without spaces, those that a word may have, and after which a long run is cut.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_IN, ENDS = rf"[^\s\p{{Z}}{_ALONE}]", r"[aeiouAEIOU0-3/.,;:_+=&-]"
WORDS = rf"({_IN}{{1,{PIECE}}}+(?!{_IN})|[{_ALONE}]|{_IN}{{3,{PIECE - 1}}}?{ENDS}|{_IN}{{1,{PIECE}}})"
#: Characters of a shuffled task, about.
TASK_CHARS = 1 << 23
#: Bits of a place in a text (places beyond them start again), and those of a hash that choose its sketch.
PLACE, CHOICE = 24, 5


def _with_place(h: Column, i: Column) -> Column:
    return F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << PLACE) - 1)))


def kmers(text: Column) -> Column:
    """The hashes of a text's k-mers with their places, ascending; of all its words if they are fewer than ``K``."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(1))

    def hashed(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: _with_place(F.xxhash64(*[F.get(w, i + j) for j in range(K)]), i))
        return F.when(F.size(w) >= K, F.sort_array(each)).when(F.size(w) > 0, F.array(_with_place(F.xxhash64(w), F.lit(0)))).otherwise(F.array().cast("array<long>"))

    return let(words, hashed)


def _kmer(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def _least(sorted_keys: Column, of: Callable[[Column], Column]) -> Column:
    """The ``TUPLE`` first of each sketch, of an array that is ascending."""
    part = lambda x: F.shiftright(of(x), 64 - CHOICE)
    return F.filter(sorted_keys, lambda x, i: (i < TUPLE) | (part(x) != part(F.get(sorted_keys, i - TUPLE))))


def _repeats(p: Column) -> Column:
    """(key, kmer) of the second and later occurrences of k-mers, by key: the hash of k-mer and number, with the place."""
    n = F.size(p)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_kmer(F.get(p, i)) != _kmer(F.get(p, i - 1))))

    def runs(s: Column) -> Column:
        spans = F.filter(F.transform(s, lambda a, j: F.struct(a.alias("a"), F.coalesce(F.get(s, j + 1), n).alias("z"))), lambda r: r["z"] - r["a"] > 1)
        later = lambda r: F.transform(F.sequence(r["a"] + 1, r["z"] - 1), lambda i: F.struct(_with_place(F.xxhash64(_kmer(F.get(p, i)), i - r["a"] + 1), F.get(p, i)).alias("key"), _kmer(F.get(p, i)).alias("kmer")))
        return F.array_sort(F.flatten(F.transform(spans, later)))

    return let(starts, runs)


def fingerprint(text: Column) -> Column:
    """The sketches of a text in their order, as one string."""

    def printed(p: Column) -> Column:
        n = F.size(p)
        firsts = F.filter(p, lambda x, i: (i == 0) | (_kmer(x) != _kmer(F.get(p, i - 1))))

        def chosen(f: Column) -> Column:
            own = F.transform(let(f, lambda a: _least(a, lambda x: x)), lambda x: F.struct(x.alias("key"), _kmer(x).alias("kmer")))
            again = let(_repeats(p), lambda a: _least(a, lambda x: x["key"]))
            both = F.when(F.size(f) < n, F.array_sort(F.concat(own, again))).otherwise(own)
            return let(both, lambda a: _least(a, lambda x: x["key"]))

        def sketch(c: Column, b: Column) -> Column:
            mine = F.filter(c, lambda x: F.shiftright(x["key"], 64 - CHOICE) == b)
            placed = F.array_sort(F.transform(mine, lambda x: F.struct(x["key"].bitwiseAND(F.lit((1 << PLACE) - 1)).alias("at"), x["kmer"].alias("kmer"))))
            print_of = lambda m: F.when(F.size(m) > 0, F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.transform(m, lambda x: x["kmer"])))), 16, "0"), 1, DIGITS)).otherwise(NONE)
            return let(placed, print_of)

        numbers = F.sequence(F.lit(-(SKETCHES // 2)), F.lit(SKETCHES // 2 - 1))
        return let(let(firsts, chosen), lambda c: F.array_join(F.transform(numbers, lambda b: sketch(c, b)), ""))

    return F.when(text.rlike(r"[^\s\p{Z}]"), let(kmers(text), printed)).otherwise(F.lit(NONE * SKETCHES))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches of two fingerprints among those that either has, 0 to 1."""
    pair = lambda i: (F.substring(a, i * DIGITS + 1, DIGITS), F.substring(b, i * DIGITS + 1, DIGITS))
    some = [F.when((x != NONE) | (y != NONE), 1).otherwise(0) for x, y in (pair(i) for i in range(SKETCHES))]
    same = [F.when((x == y) & (x != NONE), 1).otherwise(0) for x, y in (pair(i) for i in range(SKETCHES))]
    total = lambda xs: sum(xs[1:], xs[0])
    return F.when(total(some) == 0, 1.0).otherwise(total(same) / F.greatest(total(some), F.lit(1))).cast("double")


def fingerprint_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``fingerprint`` of ``text`` (null: empty)."""
    return docs.withColumn("fingerprint", fingerprint(F.coalesce(text, F.lit(""))))


def with_next(docs: DataFrame) -> DataFrame:
    """(part, nth, guest, doc_id, text, next): every document with the text of the next one in order of doc_id; after the last, the first.

    Documents are partitioned by ranges of doc_id.  Each range is followed by
    a guest, the first document of the next range that has any.
    """
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", ranges(docs, "doc_id"))
    firsts = docs.groupBy("part").agg(F.min("doc_id").alias("f_id"))
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select(F.col("part").alias("f_part"), "f_id", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.last("part").over(everything)).alias("to"))
    # at most KNOTS * (MOST_PER + 1) + 2 rows: a proven bound
    guests = docs.join(F.broadcast(before), (docs.part == before.f_part) & docs.doc_id.eqNullSafe(before.f_id)).select(F.col("to").alias("part"), F.lit(1).alias("guest"), "doc_id", "text")
    both = docs.select("part", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests).repartition(int(-(-chars // TASK_CHARS)) + 1, "part")
    w = Window.partitionBy("part").orderBy("guest", "doc_id", "text")
    return both.select("part", F.row_number().over(w).alias("nth"), "guest", "doc_id", "text", F.lead("text").over(w).alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars/4) characters replaced by as
    many first ones (or all) of the next document.  Null texts are empty; a
    text without words has a fingerprint without sketches.  Rows with equal
    doc_id are in order of their texts, null doc_ids come first, and a single
    document is its own next one.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    rows = with_next(docs).select("part", "nth", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("guest") == 0, edited).otherwise("").alias("edited"))
    prints = rows.select("part", "nth", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    followed = prints.withColumn("next_print", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("nth"))).where("guest = 0")
    return followed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
