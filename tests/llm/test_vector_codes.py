import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from briefloom.llm.vector_codes import VECTOR_CODES_SQL, Neighbours, books_digest, code_vectors, vector_codes_query

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(books[p], cut(v, p))[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    out, totals = [], {}
    for i, v, label in kept:
        found = [nearest(books[p], cut(v, p)) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, code, error, totals[label], digest) for i, code, error, label in out)


def test_against_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.choice([rng.gauss(0, 0.2), 0.5, -0.25]))) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, rows[i][1], 7) for i in range(40)]  # exact copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] + [0.0] * 31, 1), (2003, [math.nan] * 32, 1), (2004, [math.inf] * 32, 1), (2005, [-0.0] * 32, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, vector_codes_query(spark, str(tmp_path)).collect())) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(VECTOR_CODES_SQL).fetchall()) == brute(rows)


@pytest.mark.parametrize("spread", [1, 3, 1000, (1 << 26) - 1])
def test_search_equals_a_scan_of_all_entries(spread):
    """Any start leads to the nearest entry; small spreads make ties and equal entries."""
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (40, 4))
    points = rng.integers(-spread, spread + 1, (500, 4))
    apart = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    best, least = Neighbours(entries).nearest(points, rng.integers(0, 40, 500))
    assert (best == apart.argmin(1)).all() and (least == apart.min(1)).all()


def test_search_reads_a_part_of_the_list():
    """Near its entry, a point reads a few neighbours of a spread codebook."""
    rng = np.random.default_rng(1)
    book = Neighbours(rng.integers(-10_000, 10_000, (64, 4)))
    points = book.entries + rng.integers(-50, 50, (64, 4))
    reach = [int(np.searchsorted(book.apart[k], 4 * int(((points[k] - book.entries[k]) ** 2).sum()), side="right")) for k in range(64)]
    assert max(reach) < 8


def test_few_vectors_and_defined_cases(spark):
    rows = [(None, [9.0] * 16, None), (3, [1.0] * 16, 1), (3, [0.5] * 16, 1), (2, [0.25] * 15, 1), (5, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "code").where("vec_id IS NULL OR vec_id <> 2")
    found, books = code_vectors(df, keep=("code",), entries=3)
    assert books.shape == (16, 3, 1) and books[0].ravel().tolist() == [128, 2304, 256] and len(books_digest(books)) == 64
    got = sorted(((r["id"], r["codes"][0], r["error"]) for r in found.collect()), key=str)
    assert got == [(3, 0, 0), (3, 2, 0), (5, 2, 0), (None, 1, 0)]
    other, _ = code_vectors(spark.createDataFrame(rows[1:], SCHEMA).where("vec_id <> 2").unionByName(spark.createDataFrame([(9, [1.0] * 15, 1)], SCHEMA)))
    assert sorted(r["id"] for r in other.collect()) == [3, 3, 5]
    assert code_vectors(df.limit(0))[0].count() == 0
    with pytest.raises(ValueError, match="do not divide"):
        code_vectors(spark.createDataFrame([(1, [1.0] * 15, 1)], SCHEMA))
    with pytest.raises(Exception, match="beyond"):
        code_vectors(spark.createDataFrame([(1, [1e9] * 16, 1)], SCHEMA))[0].collect()
