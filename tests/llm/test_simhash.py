import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from briefloom.llm.components import connected_components
from briefloom.llm.simhash import covering_masks, fingerprint, near_duplicates, near_links, simhash_query


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """The smallest node that each reaches, by search over all pairs."""
    found = {}
    for start in sorted(nodes):
        waiting = [start] if start not in found else []
        while waiting:
            x = waiting.pop()
            if x not in found:
                found[x] = start
                waiting += [y for y in nodes if y not in found and linked(x, y)]
    return found


def brute(docs, radius=2):
    prints = {i: plain_fingerprint(t) for i, t in docs}
    found = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    return sorted((i, f"{prints[i]:016x}", found[i]) for i in prints)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = ["Ab", "cd", "é", "fgh", "I", "jkl", " x", "mno"]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 30, 400]))]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, "\t".join(text[:-1] + [rng.choice(words)]))]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "long word " * 70_000), (1006, "LONG word " * 70_000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, simhash_query(spark, str(tmp_path)).collect())) == brute(docs)


def test_documents_of_the_small_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash_query(spark, "/root/testdata/sf0.001").collect())) == brute(docs)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    for free in ((1 << 64) - 1, 0x0F0F00FF00000000, 0b111111 << 20):
        masks = covering_masks(free, radius)
        assert len(masks) == (2 << radius) - 1 and all(m & ~free == 0 and m for m in masks)
        places = [i for i in range(64) if free >> i & 1]
        for _ in range(3000):
            apart = sum(1 << i for i in rng.sample(places, radius))
            assert any(m & apart == 0 for m in masks)


@pytest.mark.parametrize("most", [1, 20, 10**6])
def test_dense_buckets_are_covered_again(spark, most):
    """Fingerprints that differ in few positions fill a table's buckets; the links are those of all pairs at any size of a bucket."""
    rng = random.Random(11)
    fps = {rng.getrandbits(14) << 30 for _ in range(700)} | {rng.getrandbits(64) for _ in range(200)}
    near = list(fps)[:50]
    fps |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in near}
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = near_links(rows, 2, most)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    labels = {r["node"]: r["component"] for r in connected_components(links).collect()}
    signed = [r["fp"] for r in rows.collect()]
    want = components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {x: labels.get(x, x) for x in signed} == want


def test_defined_cases(spark):
    rows = [(None, "a b c", 1), (4, "a b c", 2), (4, "a b c", 2), (3, "A b  c", 3), (None, "other words are here", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["id"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    assert got == [(3, 3), (4, 3), (4, 3), (None, 3), (None, None)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert fingerprint(b"") == 0 == fingerprint(b" \x0b\x0c")
    assert fingerprint(" ".encode()) == xxhash.xxh64_intdigest(" ".encode(), 42)
