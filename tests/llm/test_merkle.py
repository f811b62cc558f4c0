import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from briefloom.llm.merkle import MANIFEST_SQL, fold, levels, manifest, manifest_query, merkle_proofs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, fan=8):
    """The root, and for each leaf its siblings before and after, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i // fan * fan
            paths[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fan])))
            at[k] = i // fan
        nodes = [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inside = {}
    for g in names:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(*d)))
        inside[g] = tree([leaf_of(*d) for d in groups[g]])
    root, outside = tree([inside[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for d, path in zip(groups[g], inside[g][1], strict=True):
            path = path + outside[k]
            folded = leaf_of(*d)
            if d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                folded = leaf_of(d[0], "".join(c.lower() if c.isascii() else c for c in d[1]), *d[2:])
            for before, after in path:
                folded = digest(before, folded, after)
            out.append((d[0], leaf_of(*d), inside[g][0], root, digest(*[x for p in path for x in p]), folded, folded == root))
    return sorted(out, key=str)


def documents():
    rng = random.Random(3)
    docs = [(rng.randrange(10**9), rng.choice(["", "Ab c", "ÄÖ straße", "x" * 9000, "Z"]) + str(rng.random()), rng.choice(["en"] * 6 + ["de"]), "src", 7) for _ in range(700)]
    docs += [(5_000_000_000, None, None, None, None), (5_000_000_001, "", "é", "", 0), (5_000_000_002, "Q", "z", None, -1), (7, "lone", "zz", "s", 1)]
    return docs


def test_against_brute_force_and_sql(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in manifest_query(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == brute(docs)
    assert {r[-1] for r in rows} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(MANIFEST_SQL).fetchall(), key=str) == brute(docs)


@pytest.mark.parametrize("n", [1, 8, 9, 63, 64, 65, 130])
def test_buckets_are_whole_subtrees(spark, n):
    """Groups that end within, at and behind a bucket of nine leaves and runs of three."""
    leaves = spark.createDataFrame([(g, i, digest(g, str(i)), "kept") for g in "ab" for i in range(n if g == "a" else 4)], "grp string, row long, h string, subroot string").drop("subroot")
    found = merkle_proofs(leaves, "grp", "row", "h", fan=3, depth=2)
    rows = found.withColumn("folded", fold(F.col("h"), F.col("before"), F.col("after"))).collect()
    tops = {g: tree([digest(g, str(i)) for i in range(n if g == "a" else 4)], 3) for g in "ab"}
    root, outer = tree([tops[g][0] for g in "ab"], 3)
    assert len(rows) == n + 4 and {r["folded"] for r in rows} == {root} == {r["root"] for r in rows}
    for r in rows:
        assert r["subroot"] == tops[r["grp"]][0]
        assert list(zip(r["before"], r["after"], strict=True)) == tops[r["grp"]][1][r["row"]] + outer["ab".index(r["grp"])]


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "g string, id long, h string")
    assert merkle_proofs(empty, "g", "id", "h").count() == 0 == manifest(empty, "g", "id", "h").count()
    one = spark.createDataFrame([("g", 1, "aa")], "g string, id long, h string")
    row = merkle_proofs(one, "g", "id", "h").first()
    assert (row["subroot"], row["root"], row["before"]) == ("aa", "aa", [])
    same = spark.createDataFrame([(None, None, "aa")] * 3 + [(None, 1, "0b")], "g string, id long, h string")
    rows = merkle_proofs(same, "g", "id", "h").collect()
    assert {r["root"] for r in rows} == {digest("aa", "aa", "aa", "0b")}
    assert sorted(r["before"][0] for r in rows) == ["", "aa", "aaaa", "aaaaaa"]
    assert [levels(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
    clash = spark.createDataFrame([("g", 1, "aa", 5), ("g", 2, "bb", 6)], "grp string, i long, h string, n int")
    assert sorted((r["i"], r["n"], r["subroot"]) for r in merkle_proofs(clash, "grp", "i", "h").collect()) == [(1, 5, digest("aa", "bb")), (2, 6, digest("aa", "bb"))]
    found = manifest(clash, "grp", "i", "h").first()
    assert (found["n_leaves"], found["root"]) == (2, digest("aa", "bb"))
