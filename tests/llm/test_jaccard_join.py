import random

from briefloom.llm.components import connected_components
from briefloom.llm.jaccard_join import choose_boundary, jaccard_components, one_of_each


def sets_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(docs):
    sets = {i: sets_of(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=12))
    texts = [None, "", "  \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 6, 8, 9, 12, 14, 20, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], rng.choice(words)]])
            texts.append(" ".join(copy) + (" " + line if rng.random() < 0.4 else ""))
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, set_id string, n int").repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
        assert got == brute(docs)


def test_lists_keep_pairs_at_any_first_shared_shingle(spark):
    """A third corpus, and sets of very different sizes within one list, as brute force links them."""
    docs = corpus(3)
    start = [f"w{i}" for i in range(40)]
    docs += [(1000 + k, " ".join(start[k % 7 :] + [f"v{j}" for j in range(k % 9)])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert got == brute(docs)


def test_groups_of_near_copies_link_through_their_original(spark):
    """Two hundred copies with one to five changed words, most of which only link with the original, as brute force links them."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(200):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 2, 2, 3, 4, 5])):
            copy[at] = f"x{i}at{at}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()} == brute(docs)


def test_real_documents_match_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()} == brute(docs)


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(1, "a b c d e f", "k"), (2, "a b c d e f", "k"), (3, None, "k"), (3, None, "k"), (1, "a b c d e f", "again"), (1, "other words than those above", "k"), (None, "a b c d e f", "k"), (None, "only here", "k"), (None, "only here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "only here"), (1, "a b c d e f"), (1, "other words than those above"), (3, ""), (3, "")]


def test_rows_with_a_null_id_take_their_component_s(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "alone"), (5, "")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in jaccard_components(df).collect()) == ["4", "4", "5", "None"]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0, 100}


def test_boundary_follows_cost():
    assert choose_boundary(1.0, 80) <= choose_boundary(50.0, 80) < choose_boundary(1e6, 80)
