import hashlib
import random

import numpy as np
import pyarrow as pa

from briefloom.llm import substring_dedup
from briefloom.llm.substring_dedup import anchors, brute_force, dedup_substrings, leftmost_minimum, long_pieces, maximal_repeats


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abé \n\0xyz") for _ in range(k))
    shared = [text(k) for k in (40, 99, 100, 101, 130, 170, 300, 700)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else text(rng.choice([0, 3, 50, 200])) for _ in range(rng.choice([0, 1, 3, 6]))]
        out.append("".join(parts))
    return [*out, "a" * 350, "ab" * 200, "z" * 90 + "a" * 200, ""]


def check(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in zip(ids, texts)], "doc_id long, text string, key string, a int").repartition(3)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in dedup_substrings(df).collect()}
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    want = dict(zip([ids[k] for k in order], brute_force([(texts[k] or "").encode() for k in order])))
    assert got == want


def test_against_brute_force(spark):
    texts = corpus(1)
    check(spark, [*texts, None], [7 * i % 1009 - 300 for i in range(len(texts) + 1)])


def test_hot_grams(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)  # read on the driver; the windows take the place of fragments
    check(spark, corpus(2, 40))


def test_pieces_own_every_anchor_once(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "short", text[:900]])], ["text"])

    def places():
        out = []
        for data, offsets, rows, piece in long_pieces(batch, "text"):
            found = anchors(data, offsets)
            pos = found["pos"] + (piece[0] if piece else 0)
            own = np.ones(len(pos), bool) if piece is None else ((pos >= piece[0] + 100) | (piece[0] == 0)) & ((pos < piece[0] + substring_dedup.SLICE + 100) | piece[1])
            out += zip(rows[found["text"]][own].tolist(), pos[own].tolist(), found["around"][own].tolist())
        return out

    whole = places()
    monkeypatch.setattr(substring_dedup, "SLICE", 257)
    assert sorted(places()) == sorted(whole)


def test_repeated_ids_and_empty_table(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (2, "x" + long), (None, long)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in dedup_substrings(df).collect())
    assert rows == [("1", 150, 150), ("1", 150, 150), ("2", 150, 150), ("2", 151, 150), ("None", 150, 0)]
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_maximal_repeats_are_left_diverse():
    rng = random.Random(3)
    core = bytes(rng.randrange(97, 123) for _ in range(140))
    pieces = [b"1" + core + b"2", b"3" + core + b"4", b"3" + core[:120] + b"5"]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    found = sorted((length, sorted(places.tolist())) for places, length in maximal_repeats(data, ends - [len(p) for p in pieces], ends))
    assert (120, [1, 143, 285]) in found and (140, [1, 143]) in found
    assert all(length >= 100 for length, _ in found)


def test_leftmost_minimum():
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert leftmost_minimum(values, 3).tolist() == [1, 1, 4, 4, 4]
