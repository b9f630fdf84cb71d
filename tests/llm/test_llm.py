"""The operators for training data against brute force, round trips and odd tables."""

import hashlib
import os
import pickle
import random
import time
import weakref
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, golay, language, linededup, masked, mixing, orderhash, simhash, topk, toxicity, warc
from tidemark.llm.components import connected_components
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one", None, "a", 3),
    (4, "Same words in this text, all of them the same.", "en", "b", 46),
    (5, "Same words in this text, all of them the same.", "en", "b", 46),
    (5, "Same words in this text, all of them the same.", "en", "b", 46),
    (None, "no id here, but some words anyway", "en", None, 33),
    (7, "line of many characters, again\n" * 40 + "é日本   end", "en", "b", None),
    (8, "x" * 300_000, "fr", "c", 300_000),
    (9, "12345 %%% \t\r\n", "en", "c", 13),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"_text": F.lit("clash"), "fp": F.lit(0), "gone": F.lit("clash"), "score": F.lit("clash"), "part": F.lit("clash")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def corpus(n=120, seed=0):
    """Texts of invented words with exact and near copies and shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(8)) for _ in range(4)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.25:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        else:
            lines = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6))]
            out.append("\n".join(lines + rng.sample(shared, rng.randint(0, 2))))
    return [(i * 3, t, rng.choice(["en", "fr"]), f"src{rng.randint(0, 9)}", len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


# 1: SimHash


def test_golay_code_is_perfect_and_fuzzy_keys_meet():
    words = golay.codewords()
    assert words.shape == (4096, 23)
    assert ((23 - words[:64] @ words.T) / 2)[np.arange(64), np.arange(64)].max() == 0
    d = (23 - words[:64] @ words.T) / 2
    assert sorted(set(d[d > 0].astype(int)))[0] == 7
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 4000)
    near = golay.nearby(v)
    assert set((near >= 0).sum(1)) == {1, 6} and (near[:, 0] >= 0).all()
    for w in (v, v ^ (1 << rng.integers(0, 23, 4000))):
        assert (golay.nearby(w) == near[:, :1]).any(1).all()


def test_fingerprint_equals_definition():
    for _, text, *_ in corpus(20) + ODD:
        words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def components_of(prints: dict) -> dict:
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = components_of({r[0]: simhash.fingerprint(r[1]) for r in corpus()})
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_links_find_all_planted_distances(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long").distinct()
    found = {tuple(sorted(r)) for r in simhash.links(df).select("a", "b").collect()}
    assert {tuple(sorted(map(signed, p))) for p in pairs} <= found


def test_connected_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(None, 3), (200, 200), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_dedup_stage_keeps_one_of_each_group(spark, odd, empty):
    out = simhash.dedup_stage(spark, odd, "")
    ids = Counter(r["doc_id"] for r in out.collect())
    assert 4 in ids and 5 not in ids and ids[None] == 1 and out.columns == odd.columns
    assert simhash.dedup_stage(spark, empty, "").count() == 0


def _shuffled(spark):
    """Bytes of the shuffle files that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.length())) if f.getName().startswith("shuffle_"))


def test_cut_leaves_no_shuffle_files(spark):
    keep = spark.conf.get(common._CLEANUP)
    before = _shuffled(spark)
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x")).repartition(4, "id")
    out = common.cut(rows)
    for _ in range(50):
        if _shuffled(spark) <= before:
            break
        time.sleep(0.1)
    # over 1 MB, that nothing else deletes before the driver's garbage is collected
    assert _shuffled(spark) <= before and out.count() == 20_000 and spark.conf.get(common._CLEANUP) == keep
    common.discard(out)


@pytest.mark.parametrize("most_bits", [common.MOST_BITS, 1 << 15])
def test_rows_among_many_ids_are_not_shuffled_whole(spark, monkeypatch, most_bits):
    monkeypatch.setattr(common, "MOST_BROADCAST", 100)
    monkeypatch.setattr(common, "MOST_BITS", most_bits)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(8_000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(1).alias("_map"))
        ids = common.cut(spark.range(0, 11_000, 20).select(F.col("id").alias("doc_id")))
        wanted = set(range(0, 8_000, 20))
        start = _shuffled(spark)
        semi = common.among(rows, ids).collect()
        anti = common.among(rows, ids, how="left_anti").collect()
        sent = _shuffled(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert sorted(r["doc_id"] for r in semi) == sorted(wanted) and semi[0].asDict().keys() == {"doc_id", "text", "_map"}
    assert Counter(r["doc_id"] for r in anti) == Counter({i: 1 for i in range(8_000) if i % 100 != 7 and i not in wanted} | {None: 80})
    if most_bits == common.MOST_BITS:
        assert sent < 8_000 * 128 // 4  # of 8,000 texts of 128 characters, twice
    common.discard(ids)


def test_dedup_stage_of_many_ids_equals_that_of_few(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[10:40] + [None, ""]
    docs = spark.createDataFrame([(i if i != 5 else None, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    few = Counter(map(tuple, simhash.dedup_stage(spark, docs, "").collect()))
    monkeypatch.setattr(common, "MOST_BROADCAST", 3)
    assert Counter(map(tuple, simhash.dedup_stage(spark, docs, "").collect())) == few and sum(few.values()) == 61 + 1


def test_similar_documents_equal_brute_force_in_families_of_edits(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    texts = []
    for size in (20, 40, 60, 120, 200):
        base = [word() for _ in range(size)]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(0, max(size // 25, 1) * 2)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [texts[0], "", texts[40]]
    sets = [simhash.shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    found = simhash.similar_documents(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(root))


def test_similar_documents_compare_no_texts_that_share_passages_only(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passages = [[word() for _ in range(9)] for _ in range(24)]
    texts = []
    for i in range(72):  # each passage in three texts, of which over a fifth is nowhere else
        texts.append(" ".join([*(word() for _ in range(20)), *passages[i % 24], *(word() for _ in range(10))]))
    texts.append(texts[0].replace(texts[0].split()[-1], "end"))
    compared, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *x: compared.append(pairs.select("a", "b").collect()) or verified(pairs, *x))
    found = simhash.similar_documents(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i for i in range(72)} | {72: 0}
    assert {tuple(p) for pairs in compared[1:] for p in pairs} <= {(72, 0)}


def test_sets_that_differ_in_too_many_hashes_are_no_pair():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    shared = rng.integers(0, 1 << 62, 100, np.uint64)
    # 75 of 100 in common with the first set are a similarity of 0.6, 95 of 0.9
    sets = [shared, *(np.concatenate([shared[:k], rng.integers(0, 1 << 62, 100 - k, np.uint64)]) for k in (75, 95, 90, 60))]
    odd = np.stack([simhash.parities(s) for s in sets])
    same = [pa.array([v] * 5, pa.int64()) for v in (7, 100 << 32)]
    ids = pa.array(range(5), pa.int64())
    b = pa.RecordBatch.from_arrays([same[0], ids, ids, same[1], *(pa.array(c.copy()) for c in odd.T)], ["key", "doc_id", "root", "at", *simhash.PARITIES])
    got = {p for out in simhash._across(0.8, True)([b]) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    assert got == {(2, 0), (3, 0), (3, 2)}


def test_keys_that_come_more_than_once_over_batches():
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(200):
        keys = sorted(rng.randint(0, 12) for _ in range(rng.randint(1, 14)))
        batches, i = [], 0
        while i < len(keys):
            n = rng.randint(0, 3)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[i : i + n], pa.int64()), pa.array(range(i, min(i + n, len(keys))), pa.int64()), pa.array([0] * len(keys[i : i + n]), pa.int64())], ["key", "doc_id", "at"]))
            i += n
        got = [x for b in simhash._several(batches) for x in b.column("doc_id").to_pylist()]
        assert got == [i for i, k in enumerate(keys) if keys.count(k) > 1]


def test_near_duplicates_of_odd_and_empty_tables(spark, odd, empty):
    got = sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in simhash.near_duplicates(odd).collect())
    assert len(got) == len(ODD)
    prints = {i: simhash.fingerprint(t) for i, t, *_ in ODD if i is not None}
    want = components_of(prints)
    assert {i: c for i, _, c in got if i != "None"} == {str(i): str(c) for i, c in want.items()}
    assert simhash.near_duplicates(empty).count() == 0


# 2: BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.vocabulary()), bpe.encoder(bpe.vocabulary())
    rng = random.Random(2)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\r\n", "a", "'s", "'LL", "é", "👍🏽", "日本", "́", "\x00", "\t", "12", "$$", "<|", "ſ", "　", "\x1c"]
    texts = [r[1] or "" for r in ODD] + [r[1] for r in corpus(30)] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += [f"a{chr(c)}1 {chr(c)}" for c in range(0x20, 0x3000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids = list(bpe.unpacked(own.encode(t)))
        assert ids == e.ids and own.decode(ids) == t
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_table(spark, odd, empty):
    rows = bpe.encode(odd, with_ids=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe.encode(empty).count() == 0


# 3: toxicity


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    votes = np.zeros((2000, 4), np.int8)
    votes[:, 0] = (y & (rng.random(2000) < 0.8)) | (rng.random(2000) < 0.01)
    votes[:, 1] = (y & (rng.random(2000) < 0.7)) | (rng.random(2000) < 0.01)
    votes[:, 2] = rng.random(2000) < 0.1
    votes[:, 3] = np.where((votes[:, :2] == 1).any(1), 0, -1)
    post, accuracy, _ = toxicity.label_model(votes)
    assert accuracy[0] > accuracy[2] and accuracy[1] > accuracy[2] and ((post > 0.5) == y).mean() > 0.8


def test_toxicity_learns_from_labels_only_and_scores_all(spark, odd, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["nasty", "awful"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, m).collect()}
    assert np.mean([got[i] == t for i, t, _ in labels]) > 0.98
    scores = [r["score"] for r in toxicity.score(odd, m).collect()]
    assert len(scores) == len(ODD) and all(0 <= s < 0.7 for s in scores)
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


# 4: language


def longest_phrases(text: str, known: str) -> int:
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i, n = max(j - 1, i + 1), n + 1
    return n


def test_cross_parsing_equals_brute_force():
    rng = random.Random(4)
    texts = {k: "".join(rng.choices(a, k=400)) for k, a in (("x", "abc "), ("y", "bcd "))}
    m = language.LanguageModel(texts)
    tests = ["".join(rng.choices("abcd ", k=rng.randint(1, 200))) for _ in range(40)] + ["zzz", "a"]
    known = {k: language.letters(t) for k, t in texts.items()}
    got = m.phrases(tests)
    for t, row in zip(tests, got):
        flat = language.letters(t)
        for k, n in zip(m.languages, row):
            assert n == longest_phrases(flat, known[k])


def test_language_of_odd_texts(spark, odd, empty, docs):
    m = language.fit(docs)
    got = {(r["doc_id"]): r for r in language.identify(odd, m).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[9]["lang_pred"] == "und" and got[4]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.language_stage(spark, odd, "")
    assert kept.columns == odd.columns and not {1, 2, 9} & {r["doc_id"] for r in kept.collect()}
    assert language.identify(empty, language.fit(empty)).count() == 0


def test_languages_of_large_alphabets_and_shared_heads(spark):
    rng = random.Random(11)
    alphabets = {f"l{i}": [chr(0x4E00 + 300 * i + j) for j in range(600)] for i in range(4)}
    text = lambda a: "SHARED LICENSE HEAD IN ANOTHER LANGUAGE " * 40 + "".join(rng.choices(alphabets[a], k=2500))
    rows = [(i, text(f"l{i % 4}"), f"l{i % 4}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, language.fit(df)).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


# 5: masked language model


def plain_scores(m, texts, inside, corpus=None):
    """The definition, word by word, with the model's base probabilities."""
    frequent = m.plain
    sets = []
    for t in corpus if corpus is not None else texts:
        w = ["", *masked.lowered(t).split(), ""]
        sets.append({(w[i - 1], w[i + 1], w[i]) for i in range(1, len(w) - 1)})
    out = []
    for own, t in enumerate(texts):
        w = masked.lowered(t).split()
        total, base = 0.0, m.base(masked.Words([masked.lowered(t)])) if w else []
        for i, x in enumerate(w):
            left, right = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
            p = float(np.exp(base[i]))
            others = [s for j, s in enumerate(sets) if not (inside and j == own)]
            if not ((left in frequent or left == "") and (right in frequent or right == "")):
                c = sum((left, right, x) in s for s in others)
                places = sum(sum((a, b) == (left, right) for a, b, _ in s) for s in others)
                p = (c + masked.STRENGTH * p) / (places + masked.STRENGTH)
            total += np.log(p)
        out.append(total)
    return out


def test_masked_scores_equal_the_definition(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(2, 5)))
    texts = [" ".join(rng.choice(["the", "of", "in", word()]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5], "", "\n", "é 日本 the", texts[7] + " " + word()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = masked.pack(df)
    m = masked.fit_blocks(packed)
    m.plain = {x for t in texts for x in masked.lowered(t).split() if m.classes(masked.Words([x]))[0] <= masked.FREQUENT}
    got = {r["doc_id"]: r["log_likelihood"] for r in masked.score_blocks(packed, m, None).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_scores(m, texts, True), rel=1e-4, abs=1e-4)
    new = ["the of the", texts[0], "zz yy"]
    other = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    m.corpus = packed
    got = {r["doc_id"]: r["log_likelihood"] for r in masked.score(other, m).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(plain_scores(m, new, False, texts), rel=1e-4, abs=1e-4)


def test_masked_probabilities_add_up(spark):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(corpus(40))], "doc_id long, text string")
    m = masked.fit(df)
    # bytes: from any byte some word goes on or ends, and all of them together have probability one
    assert np.exp(m.bytes).sum(1) == pytest.approx(np.ones(257)) and (np.exp(m.bytes[:256, 256]) > 0).all() and np.exp(m.bytes[256, 256]) == 0
    # groups: what frequent words take out is all that lacks
    total = np.exp(m.mass[m.used[1 + masked.FREQUENT :]]).sum()
    words = [x for t in corpus(40) for x in masked.lowered(t[1]).split()]
    often = list(dict.fromkeys(w for w in words if m.classes(masked.Words([w]))[0] <= masked.FREQUENT))
    assert total + np.exp(m.spelled(masked.Words(often))).sum() == pytest.approx(1, abs=1e-6)
    # classes: only those that some word has
    net = masked.Network(m.vector, m.used)
    _, logp = net.forward(np.random.default_rng(0).integers(0, masked.CLASSES, (2 * masked.SIDE, 5)))
    assert np.exp(logp).sum(1) == pytest.approx(1, abs=1e-4) and (np.exp(logp[:, ~m.used]) == 0).all()
    # and so in one context: every frequent word by its class, the others by their groups
    classes = m.classes(masked.Words(often))
    assert len(set(classes)) == len(often) == m.used[: 1 + masked.FREQUENT].sum()


def test_masked_network_makes_the_powers_of_each_class_once(monkeypatch):
    rng = np.random.default_rng(3)
    used = np.arange(masked.CLASSES) % 5 > 0
    around, target = rng.integers(0, masked.CLASSES, (2 * masked.SIDE, 300)), rng.choice(np.flatnonzero(used), 300)
    made, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: made.append(x.size) or exp(x, *a, **b))
    for scale in (1, 200):  # with large weights the powers are of differences
        vector = masked.Network(used=used).vector() * scale
        net = masked.Network(vector, used)
        hidden, logp = net.forward(around)
        assert np.allclose(net.of(around, target), logp[np.arange(300), target], rtol=1e-5, atol=1e-4) and np.isfinite(net.of(around, target)).all()
        gap = exp(logp.astype(float))
        gap[np.arange(300), target] -= 1
        back = (gap @ net.out.T.astype(float)) * (1 - hidden.astype(float) ** 2)
        want = net.embed.astype(float)
        for i in range(2 * masked.SIDE):
            total = np.zeros((masked.CLASSES, masked.WIDTH))
            np.add.at(total, around[i], back)
            want[i] -= masked.RATE * total / (np.bincount(around[i], minlength=masked.CLASSES)[:, None] + 8)
        made.clear()
        net.train(around, target)
        assert sum(made) == 300 * masked.CLASSES and np.allclose(net.embed, want, rtol=1e-4, atol=1e-4 * scale)


def test_masked_scores_do_not_depend_on_partitions(spark):
    rows = [(r[0], r[1]) for r in corpus(100, 3)] + [(None, "no id"), (None, "no id"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({(r["doc_id"], r["n_words"]): r["log_likelihood"] for r in masked.score_corpus(df.repartition(n)).collect()} for n in (1, 9))
    assert set(one) == set(many) and [many[k] for k in one] == pytest.approx(list(one.values()), rel=1e-4, abs=1e-3)


def test_masked_model_tells_texts_of_the_corpus_apart(spark, odd, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    texts = [" ".join(word() for _ in range(50)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:10]])], "doc_id long, text string")
    s = {r["doc_id"]: r["per_word"] for r in masked.score_corpus(df).collect()}
    twice = [s[i] for i in [*range(10), *range(60, 70)]]
    assert min(twice) > max(s[i] for i in range(10, 60)) + 2
    got = {r["doc_id"]: r for r in masked.score(odd, masked.fit(df)).collect()}
    assert got[1]["log_likelihood"] == got[2]["log_likelihood"] == 0 and got[1]["per_word"] is None and set(odd.columns) - {"text"} < set(got[1].asDict())
    assert masked.score_corpus(odd).count() == len(ODD) and masked.score_corpus(empty).count() == 0
    assert masked.score(empty, masked.fit(empty)).count() == 0 and masked.score(odd, masked.fit(empty)).count() == len(ODD)


# 6: line dedup


def test_cuckoo_filter_holds_what_was_inserted_and_forgets_what_was_deleted():
    rng = random.Random(6)
    f, keys = linededup.CuckooFilter(16), [rng.getrandbits(64) for _ in range(3000)]
    for k in keys:
        f.insert(k)
    f = linededup.CuckooFilter.load(f.dump())
    assert f.contains(np.array(keys, np.uint64)).all()
    others = np.array([rng.getrandbits(64) for _ in range(20000)], np.uint64)
    assert f.contains(others).mean() < 0.01
    for k in keys[:1500]:
        assert f.delete(k)
    assert f.contains(np.array(keys[1500:], np.uint64)).all() and f.contains(np.array(keys[:1500], np.uint64)).mean() < 0.05


def lines_left(rows):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(strip).translate(low)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    drop = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= 3}
    return sorted((str(i), "\n".join(x for x in (t or "").split("\n") if (k := x.strip(strip).translate(low)) not in drop or drop[k] == i)) for i, t in rows)


def test_line_dedup_equals_brute_force(spark, docs, odd, empty):
    for df, rows in ((docs, [(r[0], r[1]) for r in corpus()]), (odd, [(r[0], r[1]) for r in ODD])):
        got = sorted((str(r["doc_id"]), r["text"]) for r in linededup.dedup_lines(df.select("doc_id", "text")).collect())
        assert got == lines_left(rows)
    assert linededup.dedup_lines(empty).count() == 0


def test_rows_that_share_a_doc_id_lose_only_their_own_lines(spark):
    common_line = "this line is in many documents"
    own = [f"a clean line that only row {i} has" for i in range(4)]
    rows = [(i, common_line) for i in range(3)] + [(None, common_line + "\n" + own[0]), (None, own[1] + "\n" + common_line), (None, own[2] + "\n" + own[3]), (1, own[0] + "!")]
    found = linededup.dedup_lines(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    assert sorted(r["text"] for r in found if r["doc_id"] is None) == sorted([own[0], own[1], own[2] + "\n" + own[3]])
    assert sorted(r["text"] for r in found if r["doc_id"] == 1) == ["", own[0] + "!"]


def test_filters_keep_the_old_one_whichever_batch_brings_it(spark):
    old = linededup.CuckooFilter()
    old.insert(500 << 48 | 77)
    rows = [(0, None, k << 48, True) for k in range(1, 60)] + [(0, old.dump(), 0, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        blob = linededup._filters(spark.createDataFrame(rows, "shard int, old binary, k1 long, add boolean").coalesce(1)).first()["filter"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert linededup.CuckooFilter.load(blob).contains(np.array([500 << 48 | 77, *(k << 48 for k in range(1, 60))], np.uint64)).all()


def test_many_cuckoo_tables_and_keys_at_once():
    rng = random.Random(16)
    f, keys = linededup.CuckooFilter(1), [rng.getrandbits(64) for _ in range(9000)]
    f.tables = [np.zeros((1, 4), np.uint16) for _ in range(20)]
    for k in keys[:200]:
        f.insert(k)
    back = linededup.CuckooFilter.load(f.dump())
    assert len(back.tables) > 20 and back.contains(np.array(keys[:200], np.uint64)).all()
    whole = linededup.CuckooFilter.of(np.array(keys, np.uint64))
    assert len(whole.tables) == 1 and whole.contains(np.array(keys, np.uint64)).all()
    assert whole.contains(np.array([rng.getrandbits(64) for _ in range(20000)], np.uint64)).mean() < 0.01


def test_line_dedup_takes_time_in_proportion_to_the_lines(spark):
    import time

    took = {}
    for n in (1000, 30_000, 60_000):
        text = "\n".join(f"a line that all three of them hold, {i}\nalone {i}" for i in range(n // 2))
        df = spark.createDataFrame([(i, text, None, None, None) for i in range(3)], DOCS)
        start = time.perf_counter()
        rows = linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n")).collect()
        took[n] = time.perf_counter() - start
        assert {r["doc_id"]: r["n_dropped"] for r in rows} == {0: n // 2, 1: n // 2, 2: 0} and {r["n_lines"] for r in rows} == {n // 2 * 2}
    assert took[60_000] < 3 * took[30_000] + 2


def test_hot_lines_are_dropped_like_any_other(spark):
    rows = [(i, "the very same line in all of the texts" + (f"\nanother line of {i % 40} in some texts" if i % 2 else "")) for i in range(300)] + [(None, "the very same line in all of the texts")]
    found = sorted((str(r["doc_id"]), r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == lines_left(rows)


def test_line_stage_of_odd_and_empty_tables(spark, odd, empty):
    out = linededup.line_stage(spark, odd, "")
    assert out.columns == odd.columns
    left = dict(lines_left([(r[0], r[1]) for r in ODD]))
    assert all(r["text"] == left[str(r["doc_id"])] and r["n_chars"] == len(r["text"]) for r in out.collect() if r["doc_id"] != 5)
    assert linededup.line_stage(spark, empty, "").count() == 0


def test_line_index_changes_are_reversible(spark, docs):
    state = lambda x: (sorted(map(tuple, x.refs.select("k1", "k2", "doc_id").collect())), sorted(map(tuple, x.frequent.collect())))
    half, rest = docs.where("doc_id < 180"), docs.where("doc_id >= 180")
    whole = linededup.LineIndex.build(linededup.lines_of(docs))
    first = linededup.LineIndex.build(linededup.lines_of(half))
    grown = first.insert(rest)
    assert state(grown) == state(whole)
    back = grown.delete(rest.select("doc_id"))
    assert state(back) == state(first)
    lines = linededup.lines_of(half)
    gone = lambda x: sorted((r["doc_id"], sorted(r["gone"])) for r in x.dropped(lines).collect())
    assert gone(back) == gone(first)


# 7: top-k search


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 64)).astype(np.float32)
    v[50:150] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [1.0]), (900, None), (901, []), (902, [float("nan"), None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    bits = {i: sum(1 << j for j, x in enumerate(e) if x is not None and not x <= 0) for i, e in rows if i is not None and e is not None}
    got = {}
    for r in topk.search(df, df.where("vec_id % 100 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    for q in (0, 100, 200):
        want = sorted((bin(bits[q] ^ b).count("1"), i) for i, b in bits.items() if i != q)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    assert set(got) == {0, 100, 200}
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [3, 9])
def test_topk_of_few_vectors_and_repeated_queries(spark, k):
    rng = np.random.default_rng(8)
    v = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(6)]
    v += [v[2], (5, v[0][1])]  # a repeated row; an id with two vectors
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([*v[:2], v[0], (77, v[3][1])], df.schema)
    code = lambda e: sum(1 << j for j, x in enumerate(e) if x > 0)
    found = topk.search(df, asked, k).collect()
    for i, e in (v[0], v[1], (77, v[3][1])):
        others = sorted((bin(code(e) ^ c).count("1"), j) for j, c in {(j, code(x)) for j, x in v} if j != i)
        assert [(r["distance"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i] == others[:k]


def test_segments_follow_the_number_of_codes():
    for n in (0, 1, 5, 1000, 10**6, 10**10, 10**18):
        parts = topk.segments(n)
        assert parts[0][0] == 0 and sum(w for _, w in parts) == 64 and all(a + w == b for (a, w), (b, _) in zip(parts, parts[1:]))
    counts = [len(topk.segments(n)) for n in (1000, 10**4, 10**6, 10**10, 10**18)]
    assert counts == sorted(counts, reverse=True) and counts[0] > 4 and counts[-1] == 1


# 8: WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 400_000
    rows = [(1, "http://a/1", "x" * 200), (2, "http://a/ 2\r\n", "x" * 200), (3, None, None), (4, "u", "y" * 50), (5, "u", "y" * 50), (6, "u", big), (None, "u", "x" * 200), (7, "u", big), (7, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = str(tmp_path / "w")
    index = warc.write_archives(df, folder)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive(df).collect())
    want = sorted([("1", 200, "response", None), ("2", 200, "revisit", 1), ("3", 0, "response", None), ("4", 50, "response", None), ("5", 50, "response", None), ("6", 800_003, "response", None), ("7", 800_003, "revisit", 6), ("7", 800_003, "revisit", 6), ("None", 200, "revisit", 1)], key=str)
    assert sorted(got, key=str) == want
    for r in index.collect():
        fields, payload = warc.BundleReader(r["bundle"]).read(r["record_id"])
        assert fields["WARC-Record-ID"] == f"<{r['record_id']}>" and (fields["WARC-Type"] == "revisit" or hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"][7:])
    import zstandard

    for b in {r["bundle"] for r in index.collect()}:
        with open(b, "rb") as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1")
    assert warc.archive(df.limit(0)).count() == 0


# 9: fingerprints


def test_fingerprints_and_edits(spark, docs, odd, empty):
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda x: x[0])
    got = {r["doc_id"]: r for r in orderhash.edited_fingerprints(docs).collect()}
    for i, (k, t) in enumerate(rows):
        q, nxt = len(t) // 4, rows[(i + 1) % len(rows)][1]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    prints = {}
    for k, t in rows:
        assert prints.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.2 > np.mean([r["near_next"] for r in got.values()])
    assert orderhash.edited_fingerprints(odd).count() == len(ODD) and orderhash.edited_fingerprints(empty).count() == 0
    one = orderhash.edited_fingerprints(docs.limit(1)).collect()[0]
    assert one["near_next"] == 1.0


def test_fingerprint_takes_occurrence_numbered_kmers_in_order(spark):
    """Against a plain construction with the same hashes."""
    texts = ["a b c a b c a b c d e f", "a b c", "b", "", "q w e r t y u i o p " * 30, " ".join(str(i % 17) for i in range(400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    h = df.select("i", "text", orderhash.kmers(F.col("text")).alias("k"), orderhash.fingerprint(F.col("text")).alias("f")).orderBy("i").collect()
    num = {}
    pairs = [(x >> 24, n) for r in h for x in r["k"] for n in range(2, 60)]
    hashed = spark.createDataFrame(sorted(set(pairs)), "k long, n int").select("k", "n", F.xxhash64("k", "n").alias("h")).collect()
    num, tuples = {(r["k"], r["n"]): r["h"] for r in hashed}, []
    for r in h:
        seen, keys = Counter(), []
        for x in sorted(r["k"], key=lambda x: x & 0xFFFFFF):
            k, at = x >> 24, x & 0xFFFFFF
            seen[k] += 1
            key = x if seen[k] == 1 else num[k, seen[k]] >> 24 << 24 | at
            keys.append((key, k, at))
        for b in range(32):
            mine = sorted(x for x in keys if x[0] >> 59 == b - 16)[:2]
            digits = r["f"][8 * b : 8 * b + 8]
            assert (digits == orderhash.NONE) == (not mine)
            if mine:
                tuples.append(([k for _, k, _ in sorted(mine, key=lambda x: x[2])], digits))
        assert len(r["f"]) == 256
    made = spark.createDataFrame(tuples, "kmers array<long>, digits string").select("digits", F.lower(F.hex(F.xxhash64("kmers"))).alias("h")).collect()
    assert made and all(x["h"].rjust(16, "0")[:8] == x["digits"] for x in made)


def test_words_of_runs_without_spaces(spark):
    rng = random.Random(10)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789", k=3000))
    han = "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(600))
    texts = [run, "Q" + run, run[:1500] + "zz" + run[1500:], han, "中" + han, "x" * 5000, "a bc  def\u00a0ghi\u3000j " + "k" * 16 + " l"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r for r in rows.select("i", orderhash.fingerprint(F.col("text")).alias("f"), F.regexp_extract_all("text", F.lit(orderhash.WORDS), F.lit(1)).alias("w")).collect()}
    assert "".join(got[0]["w"]) == run and "".join(got[5]["w"]) == texts[5] and max(map(len, got[0]["w"])) <= 16
    assert got[6]["w"] == ["a", "bc", "def", "ghi", "j", "k" * 16, "l"] and got[3]["w"] == list(han)
    like = lambda a, b: spark.createDataFrame([(got[a]["f"], got[b]["f"])], "a string, b string").select(orderhash.likeness(F.col("a"), F.col("b"))).first()[0]
    assert like(0, 1) > 0.8 and like(0, 2) > 0.7 and like(3, 4) > 0.8 and like(0, 3) < 0.2


# 10: mixing


def test_mixture_deviates_by_less_than_a_block(spark):
    for of in ([(None, 2), ("a", 5), ("b", 3), ("c", 1)], [(f"s{i:02}", 1 + i % 3) for i in range(40)]):
        turns = {r["slot"]: r["stream"] for r in mixing.period(spark, of).collect()}
        d, had = sum(p for _, p in of), Counter()
        assert sorted(turns) == list(range(d))
        for t in range(d):
            had[turns[t]] += 1
            for s, p in of:
                assert abs(had[s] - p * (t + 1) / d) < 1


def test_every_source_of_the_table_deviates_by_less_than_a_block(spark, docs):
    rows = mixing.mix(docs, {"src1": 3, "src2": 2}, block=1).orderBy("slot").collect()
    names = sorted({r["source"] for r in rows})
    share = {n: {"src1": 3, "src2": 2}.get(n, 1) for n in names}
    size, d = Counter(r["source"] for r in rows), sum(share.values())
    assert len({r["slot"] for r in rows}) == len(rows)
    for n in names:  # as long as it lasts
        mine = [r["slot"] for r in rows if r["source"] == n]
        assert len(mine) == size[n] and all(abs((k + 1) - share[n] * (t + 1) / d) < 1 for k, t in enumerate(mine))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src1": 0})


def test_mixture_keeps_all_rows(spark, odd, empty, docs):
    out = mixing.mix(odd).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ODD)
    assert mixing.mix(empty).count() == 0
    staged = mixing.mixing_stage(spark, odd, "")
    assert staged.columns == odd.columns and staged.count() == len(ODD)
    m = mixing.mix(docs, {"src1": 1, "src2": 2}, 4, 2)
    many = mixing.mix(odd).select("doc_id", "source", "slot", "place").distinct()
    assert many.count() == len(ODD)  # repeated rows have places of their own
    places = m.select("slot", "place").collect()
    assert len(places) == len(set(places)) == docs.count()


def test_last_stage_keeps_the_mixture_over_several_files(spark, docs):
    mixed = common.cut(mixing.mixing_stage(spark, docs, "").repartition(7), "several")
    assert len(mixed.inputFiles()) > 1
    done = [(r["doc_id"], r["slot"], r["place"]) for r in bpe.encode_stage(spark, mixed, "").collect()]
    want = sorted(((r["slot"], r["place"], r["doc_id"]) for r in mixing.mix(docs).collect()))
    assert done == [(i, s, p) for s, p, i in want]


# queries and pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == names
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(str(tuple(r)) for r in want.select(*[f'"{n}"' for n in names]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and 0.5 * before <= out.count() <= docs.count()
        docs = out
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    done = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    assert set(done) == set(ids)
    for r in docs.collect():
        assert done[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_language_model_is_sent_without_its_table():
    m = language.LanguageModel({"a": "one two three two one", "b": "uno dos tres dos uno", "c": ""})
    texts = ["one two", "tres uno!", "", "zzz", "two tres " * 40]
    found = m.phrases(texts)
    sent = pickle.loads(pickle.dumps(m))
    assert "table" in vars(m) and "table" not in vars(sent)
    assert (sent.phrases(texts) == found).all() and (sent.table == m.table).all()


def test_words_do_not_depend_on_the_pieces_they_are_made_in(monkeypatch):
    texts = [b"", b"a bb  ccc a", b"x" * 700 + b" y", b" ", "été naïve".encode()]
    model = masked.MaskedModel([b"a"], np.ones((257, 257), np.int64))
    whole = masked.Words(texts)
    spelled = model.spelled(whole)
    for size in (1, 3, 64):
        monkeypatch.setattr(masked, "PIECE", size)
        w = masked.Words(texts)
        pieces = list(w.pieces())
        assert pieces[0][0] == 0 and pieces[-1][1] == len(w.sizes) and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert (w.hash == whole.hash).all() and np.allclose(model.spelled(w), spelled, rtol=1e-12)
    assert list(masked.Words([]).pieces()) == []


def test_a_task_of_another_operator_drops_the_encoder(spark, monkeypatch):
    """A worker that goes from stage to stage of the pipeline does not hold what all of them keep."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    ran = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: ran.append(f) or self)
    bpe.encode(docs)
    simhash._prints(docs, 5)
    encode, prints = ran
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"]})
    assert list(encode(iter([rows])))[0].num_rows == 1
    held = weakref.ref(bpe.encoder(bpe.vocabulary()))
    assert list(encode(iter([rows])))[0].num_rows == 1
    assert held() is not None and held() is bpe.encoder(bpe.vocabulary())
    assert list(prints(iter([rows])))[0].num_rows == 1
    assert held() is None
