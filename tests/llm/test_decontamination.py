import random

from briefloom.llm.decontamination import BlockMaxIndex, PassageFilter, find_leaks, overlap, question_and_answer, terms_of, without_leaks


def brute_scores(index, terms):
    terms = set(terms)
    scores = {}
    for term, postings in index.lists.items():
        if term in terms:
            for item, impact in postings:
                scores[item] = scores.get(item, 0) + impact
    return scores


def index_of(texts):
    docs = [terms_of(t.encode()) for t in texts]
    holders = {}
    for d in docs:
        for t in set(d):
            holders[t] = holders.get(t, 0) + 1
    postings = [(i, t, d.count(t), len(d), holders[t]) for i, d in enumerate(docs) for t in set(d)]
    return BlockMaxIndex(postings, len(docs), sum(map(len, docs)) / len(docs), len(docs))


def test_search_and_pivot_test_lose_nothing():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["the", "of"] * 20
    texts = [" ".join(rng.choices(words, k=rng.randrange(5, 30))) for _ in range(120)]
    index = index_of(texts)
    passages = PassageFilter(index, 30)
    for _ in range(200):
        query = terms_of(" ".join(rng.choices(words, k=rng.randrange(1, 70))).encode())
        if rng.random() < 0.5:
            query += terms_of(rng.choice(texts).encode())
        want = {i: s for i, s in brute_scores(index, query).items() if s >= 0.5}
        got = index.search(query, 0.5)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        open_at = {c for _, c in passages.open_passages([query])}
        for at in range(max(1, -(-len(query) // 30) - 1)):
            if any(s >= 0.5 for s in brute_scores(index, query[at * 30 : (at + 2) * 30]).values()):
                assert at in open_at


def test_question_and_answer():
    assert question_and_answer("a b\nc d\n") == ("a b", "c d")
    assert question_and_answer("One two. Three four.") == ("One two.", " Three four.")
    assert question_and_answer("only") == ("only", "")
    assert overlap([b"a", b"b"], [b"x", b"a", b"b"]) == 1.0 and overlap([], []) == 1.0


def test_leaks_are_found_and_others_kept(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=25)) + ".\n" + " ".join(rng.choices(words, k=8)) + ".") for i in range(30)] + [(30, None), (31, ""), (3, "dup dup words of another item here")]
    noise = lambda k: " ".join(rng.choices(words, k=k))
    docs = [(i, noise(rng.choice([0, 20, 300]))) for i in range(40)] + [(100, None), (101, noise(500) + " " + items[7][1].upper() + " " + noise(300)), (102, items[3][1].replace(".", "")), (103, items[5][1].split("\n")[0]), (103, items[6][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "s", 0.5) for i, t in docs], "doc_id long, text string, item_id string, score double").repartition(3)
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(df, benchmark).collect())
    assert got == [(101, 7), (102, 3), (103, 6)]
    kept = without_leaks(df, benchmark)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 100]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).count() == 0
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
