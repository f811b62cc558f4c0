import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from briefloom.llm import lm_scoring
from briefloom.llm.common import crc_bucket
from briefloom.llm.lm_scoring import Automaton, Vocabulary, score_texts

TEXTS = ["The cat sat on the mat", "the cat sat", None, "", "a cat and the cat sat on", "zzz the cat", "The  CAT\tsat\non the mat é", "the cat sat on the mat"] * 3


def brute(texts, ids):
    """A bigram model with discounts of one half by definition, over dictionaries."""
    split = [(t or "").encode().lower().split() for t in texts]
    train = [w for w, i in zip(split, ids) if zlib.crc32(str(i).encode()) % 10 != 0]
    c = Counter(w for t in train for w in [*t, b""])
    n, v = sum(c.values()), len(c)
    scale = n + 0.1 * (v + 1)
    uni = lambda w: (c[w] + 0.1) / scale
    pairs = Counter(p for t in train for p in zip([None, *t], [*t, b""]))
    kept = {p: k for p, k in pairs.items() if k >= 2 and (p[0] is None or c[p[0]] >= 2) and c[p[1]] >= 2}
    seen = lambda h: len(train) if h is None else c[h]
    share = {g: (k - 0.5) / seen(g[0]) for g, k in kept.items()}
    left = Counter()
    for g, x in share.items():
        left[g[0]] += x
    chance = lambda g: share.get(g, 0) + (1 - left[g[0]]) * uni(g[1])
    out = {}
    for i, t in zip(ids, split):
        base = sum(math.log10(uni(w)) for w in [*t, b""])
        score = sum(math.log10(chance(g)) for g in zip([None, *t], [*t, b""]))
        out[i] = (len(t) + 1, sum(c[w] > 0 for w in [*t, b""]), n, base, score)
    return out


def test_against_definition(spark):
    ids = list(range(len(TEXTS)))
    docs = spark.createDataFrame(list(zip(ids, TEXTS, TEXTS)), "doc_id long, text string, word string").repartition(3)
    rows = score_texts(docs, crc_bucket("doc_id", 10) != 0).collect()
    want = brute(TEXTS, ids)
    assert sorted(r["doc_id"] for r in rows) == ids
    for r in rows:
        assert np.allclose([r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]], want[r["doc_id"]]), (r, want[r["doc_id"]])


def test_empty_table_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(none, crc_bucket("doc_id", 10) != 0).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = score_texts(one, crc_bucket("doc_id", 10) == 11).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and abs(row["base_score"]) < 1e-9


def test_probabilities_of_a_trigram_automaton_sum_to_one():
    words = [b"a", b"b", b""]
    v = Vocabulary(words)
    counts = np.array([40, 30, 10])
    two = {(0, 1): 20, (1, 0): 12, (v.start, 0): 9, (1, 2): 8}
    keys = np.array(sorted(a * v.size + b for a, b in two))
    found = np.array([two[k // v.size, k % v.size] for k in keys.tolist()])
    at = {k: i for i, k in enumerate(keys.tolist())}
    three = {(0, 1, 0): 7, (v.start, 0, 1): 6}
    keys3 = np.array(sorted(at[a * v.size + b] * v.size + c for a, b, c in three))
    found3 = np.array([6, 7]) if keys3[0] == at[v.start * v.size] * v.size + 1 else np.array([7, 6])
    machine = Automaton(v, counts, 10, [(keys, found), (keys3, found3)], 80, 3)
    unseen = 0.1 / (80 + 0.1 * 4)
    for state in range(len(machine.failure)):
        weights, s = 0.0, state
        while s:
            weights += machine.weight[s]
            s = machine.failure[s]
        assert abs(sum(10 ** machine.step(state, w)[1] for w in range(3)) + 10**weights * unseen - 1) < 1e-9


def test_rare_trigrams_of_a_large_corpus_are_kept(spark, monkeypatch):
    """Against a model over dictionaries, on texts with so many tokens that a share of 1e-5 would drop their n-grams."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000, raising=False)
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 3000)}" for _ in range(1000)) for _ in range(320)]
    texts += ["rare phrase here again", "one rare phrase here again", "rare phrase here again now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in score_texts(docs, F.lit(True), order=3).collect()}
    marked = [[None, *t.encode().split(), b""] for t in texts]
    c = Counter(tuple(t[i : i + n]) for t in marked for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total, kinds = sum(map(len, marked)) - len(texts), sum(len(g) == 1 for g in c) - 1
    assert math.ceil(1e-5 * total) > 3
    share = {g: (k - 0.5) / c[g[:-1]] for g, k in c.items() if len(g) > 1 and k >= 2}
    left = Counter()
    for g, x in share.items():
        left[g[:-1]] += x

    def chance(g):
        if len(g) == 1:
            return (c[g] + 0.1) / (total + 0.1 * (kinds + 1))
        return share.get(g, 0) + (1 - left[g[:-1]]) * chance(g[1:])

    for i, t in enumerate(marked):
        want = sum(math.log10(chance(tuple(t[max(0, e - 2) : e + 1]))) for e in range(1, len(t)))
        assert rows[i]["train_tokens"] == total and abs(rows[i]["score"] - want) < 1e-6, (i, rows[i], want)
