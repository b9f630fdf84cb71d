"""Toxicity scores by weak supervision (operator 3).

Voters are words (lexicon) and word beginnings (patterns) that labelled rows
show to go with toxic texts, and one for clean texts that sees none of them.
A generative label model, fitted by expectation maximisation without any
label, estimates how often each voter is right; voters whose errors go
together share their weight.  Its posteriors are the labels that a logistic
regression over the presence of words and beginnings is trained on, which
scores every whole text; a slope and a shift make its scores shares of
labelled rows.

Bounded sample: at most about ``MAX_ROWS`` labelled rows, picked by a hash of
doc_id, are learned from.  Every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, fresh, small_batches, table

#: Labelled rows that are learned from, about; features; voters of each kind.
MAX_ROWS, MAX_FEATURES, MAX_VOTERS = 20_000, 2000, 48
#: Voters of a kind that a toxic row should have.
COVERED = 4
#: Toxic rows that a feature must be in, and how pure it must be to become a voter.
MIN_SUPPORT, MIN_PURITY = 4, 0.8
#: Lengths of the beginnings of longer words that are patterns.
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
ROUNDS, STEPS, RATE, DECAY = 10, 400, 0.5, 1e-4


def features_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a text, and their beginnings, marked by an asterisk."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


@dataclass
class ToxicityModel:
    """Weights of features; the score of a text is the logistic of their sum over those that it has."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    #: What the label model found: voter -> (accuracy, sum of its correlations with the others).
    voters: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        get, z = self.weights.get, self.bias
        words = set(_WORD.findall((text or "").lower()))
        for w in words:
            z += get(w, 0.0)
        for n in BEGINNINGS:
            for b in {w[:n] for w in words if len(w) > n}:
                z += get(b + "*", 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracy, correlation) from ``votes`` (rows, voters): 1 toxic, -1 clean, 0 none.

    Whether a voter votes says nothing of the label; what it votes is right
    with its accuracy, 0.6 to 0.98.  What the label leaves unexplained of
    two voters' votes is their correlation: in a row, a vote counts one over
    one plus its correlations with the other votes of that row.
    """
    votes = votes.astype(float)
    yes, no = votes == 1, votes == -1
    said = np.abs(votes)
    post = np.where(yes.any(1), 0.95, 0.05)
    correlation, shared = np.zeros((votes.shape[1],) * 2), np.ones(votes.shape)
    for step in range(ROUNDS):
        accuracy = np.clip((post @ yes + (1 - post) @ no + 1) / (said.sum(0) + 2), 0.6, 0.98)
        if step == ROUNDS // 2:
            rest = votes - np.outer(post, post @ votes / max(post.sum(), 1e-9)) - np.outer(1 - post, (1 - post) @ votes / max((1 - post).sum(), 1e-9))
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            correlation = np.clip((rest / spread).T @ (rest / spread) / max(len(votes), 1), 0, 1)
            np.fill_diagonal(correlation, 0)
            shared = 1 + said @ correlation
        prior = float(np.clip(post.mean(), 1e-3, 0.5))
        logit = np.log(prior / (1 - prior)) + (votes / np.sqrt(shared)) @ np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, accuracy, correlation


def logistic(rows: list[list[int]], targets: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over present features, by full-batch AdaGrad on soft labels."""
    lengths = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(n), -2.0
    seen, seen_b = np.full(n, 1e-8), 1e-8
    balance = np.where(targets > 0.5, 0.5 * len(rows) / max((targets > 0.5).sum(), 1), 0.5 * len(rows) / max((targets <= 0.5).sum(), 1))
    balance = np.sqrt(balance)
    for _ in range(STEPS):
        z = b + np.bincount(owner, w[flat], len(rows))
        gap = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) / max(len(rows), 1)
        g = np.bincount(flat, gap[owner], n) + DECAY * w / max(len(rows), 1)
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
        seen_b += gap.sum() ** 2
        b -= RATE * gap.sum() / np.sqrt(seen_b)
    return w, float(b)


def calibration(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the logistic of ``slope * z + shift`` the share of toxic rows, by Newton's method."""
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3])
        a = a - np.clip(np.linalg.solve(h, x.T @ (p - labels) + 1e-3 * (a - [1, 0])), -1, 1)
    return float(max(a[0], 0.05)), float(a[1])


def covering(candidates: list[int], seen: list[tuple[list[int], int]]) -> list[int]:
    """Up to ``MAX_VOTERS`` candidates, best first, of which each is in a toxic row that has under ``COVERED`` so far: no kind of toxic text is left out for a more frequent one."""
    rows: dict[int, list[int]] = {}
    for r, (row, toxic) in enumerate(seen):
        if toxic:
            for i in row:
                rows.setdefault(i, []).append(r)
    covered, out = [0] * len(seen), []
    for i in candidates:
        own = rows.get(i, ())
        if sum(covered[r] < COVERED for r in own) >= MIN_SUPPORT // 2:
            out.append(i)
            for r in own:
                covered[r] += 1
            if len(out) == MAX_VOTERS:
                break
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; rows with a null doc_id are not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from the rows with a label that are not held out; without toxic ones the score of every text is low."""
    small_batches(docs.sparkSession)
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    share = 1_000_000 * min(1.0, MAX_ROWS / max(n, 1))
    marked = marked.where(F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(1_000_000)) < share)
    rows = cut(docs.join(marked, F.col("doc_id") == F.col("l_id")).select("text", "toxic"), "toxicity-sample")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, toxic = [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features_of(t)
                names += f
                toxic += [y] * len(f)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])

    totals = {int(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic_rows, clean_rows = totals.get(1, 0), totals.get(0, 0)
    if not toxic_rows:
        return ToxicityModel()
    counted = rows.mapInArrow(found, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    p, q = (F.col("t") + 0.5) / (toxic_rows + 1.0), (F.col("c") + 0.5) / (clean_rows + 1.0)
    # in how many more toxic rows than expected, by the spread of that
    z = (F.log(p) - F.log(q)) * F.sqrt("t")
    best = counted.where((F.col("t") >= MIN_SUPPORT) & (p > q)).select("feature", "t", "c", z.alias("z")).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    names = [r["feature"] for r in best]
    place = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sorted(place[f] for f in features_of(t) if f in place) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), b.column(1)], ["present", "toxic"])

    # at most about MAX_ROWS rows of some numbers each; equal rows make the fit independent of their order
    seen = sorted((list(r[0]), r[1]) for r in rows.mapInArrow(present, "present array<int>, toxic int").collect())
    have = [x for x, _ in seen]
    pure = [i for i, r in enumerate(best) if r["t"] / (r["t"] + r["c"] * toxic_rows / max(clean_rows, 1)) >= MIN_PURITY]
    words = covering([i for i in pure if not names[i].endswith("*")], seen)
    patterns = covering([i for i in pure if names[i].endswith("*")], seen)
    voters = words + patterns
    if not voters:
        return ToxicityModel()
    at = {i: k for k, i in enumerate(voters)}
    votes = np.zeros((len(have), len(voters) + 1), np.int8)
    for r, row in enumerate(have):
        for i in row:
            if i in at:
                votes[r, at[i]] = 1
    # one voter for clean texts: neither word nor pattern
    votes[:, -1] = np.where((votes == 1).any(1), 0, -1)
    post, accuracy, correlation = label_model(votes)
    w, b = logistic(have, post, len(names))
    slope, shift = calibration(np.array([b + w[row].sum() for row in have]), np.array([y for _, y in seen], float))
    w, b = slope * w, slope * b + shift
    known = [names[i] for i in voters] + ["none"]
    return ToxicityModel({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, b, {f: (float(t), float(k)) for f, t, k in zip(known, accuracy, correlation.sum(0))})


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, with score (0 to 1) and predicted (score >= 0.7); null texts score as empty ones."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    whole = fresh(docs, "_text")
    kept = docs.select(*[c for c in docs.columns if c not in (text, "score", "predicted")], F.col(text).alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop(whole).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(t) for t in b.column(b.num_columns - 1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(run, f"{schema}, score double, predicted int".lstrip(", "))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
