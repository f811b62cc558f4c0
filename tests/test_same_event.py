"""The same-event stack against plain loops over Python values."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from briefloom.functions import similarity
from briefloom.operators import events, pairs, social

STOPPED = set(similarity.STOP_WORDS)
DAY = 86_400_000


def normal(title):
    return re.sub(r"[^\w一-鿿]+|(独家|详解|速递|刚刚|突发|重磅|报道|：|:)", "", (title or "").strip().lower())


def anchors(text):
    words = re.findall(r"[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*|\d+(?:\.\d+)*", (text or "").lower())
    return [w for w in words if w not in STOPPED and (len(w) >= 3 or any(map(str.isdigit, w)))]


def similar(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    return 0.92 if len(short) >= 16 and short in long else SequenceMatcher(None, a, b).ratio()


def near(words):
    return set(zip(words, words[1:]))


def names(words):
    return {w for w in words if len(w) >= 4 and not any(map(str.isdigit, w))}


def entity(a, b):
    x, y = anchors(a), anchors(b)
    shared = set(x) & set(y)
    versions = [w for w in shared if any(map(str.isdigit, w)) and not re.fullmatch(r"(?:19|20)\d{2}", w)]
    return bool(len(shared) >= 2 and names(shared) and versions and near(x) & near(y) and len(shared) >= 0.55 * len(set(x) | set(y)))


def same(later, earlier, least):
    return similar(normal(later), normal(earlier)) >= least or entity(later, earlier)


def walk(titles, least):
    leaders, out = [], []
    for i, title in enumerate(titles):
        out.append(next((j for j in leaders if same(title, titles[j], least)), i))
        if out[-1] == i:
            leaders.append(i)
    return out


def titles_of(rng, n):
    words = ["Acme", "Opus", "5", "Sonnet", "4.1", "2026", "quantum", "chips", "cheaper", "the", "大模型", "发布会", "今天", "重磅", "Studio", "o3"]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8]))) for _ in range(n // 2)]
    for _ in range(n - len(made)):
        t = list(rng.choice(made))
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(len(t)) if t else 0 :][:1] = [rng.choice("abx大5 ")]
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.choice([0, 1])] = rng.choice(["", "s", "新", " !"])
        made.append("".join(t) + rng.choice(["", "", " as reported by someone else today"]))
    return made + ["", None, "!", "ab", "abc", "aXb", "x" * 40, "x" * 41]


@pytest.mark.parametrize(("seed", "least"), [(1, 0.85), (2, 0.95)])
def test_clusters_equal_the_walk(spark, seed, least):
    rng = random.Random(seed)
    days = {d: titles_of(rng, 120) for d in ("a", None)}
    rows = [(d, i, t) for d, titles in days.items() for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "day string, n int, t string").withColumn("event_of", F.lit(1)).repartition(3)
    got = {(r["day"], r["n"]): r["event"] for r in events.cluster(df, ["day"], "t", ["n"], least).collect()}
    for day, titles in days.items():
        assert [got[day, i] for i in range(len(titles))] == walk(titles, least)


def test_leaders_of_a_long_chain_and_of_a_star(spark):
    chain = [(0, i + 1, i) for i in range(7)]
    star = [(1, i, 0) for i in range(1, 60)]
    late = [(2, 5, 1), (2, 5, 2), (2, 2, 1), (2, 9, 5), (2, 9, 2)]
    found = {(r["grp"], r["late"]): r["early"] for r in events.leaders(spark.createDataFrame(chain + star + late, "grp int, late int, early int")).collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == 0} == {1: 0, 3: 2, 5: 4, 7: 6}
    assert {k[1]: v for k, v in found.items() if k[0] == 1} == {i: 0 for i in range(1, 60)}
    assert {k[1]: v for k, v in found.items() if k[0] == 2} == {5: 1, 2: 1}
    assert events.leaders(spark.createDataFrame([], "grp int, late int, early int")).count() == 0


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_candidates_lose_no_pair_at_any_list_length(spark, most):
    """Sets over few tokens: every list is long, and is split by the next common token as far as need be."""
    rng = random.Random(9)
    sets = {i: rng.sample("abcdefghijkl", rng.choice([1, 2, 3, 6, 9])) for i in range(150)}
    need = {i: max(1, len(s) * 2 // 3) for i, s in sets.items()}
    df = spark.createDataFrame([(0, i, s, need[i], len(s)) for i, s in sets.items()], "grp int, id long, tokens array<string>, need int, known int")
    got = {(r["a"], r["b"]) for r in pairs.overlap_candidates(df, most=most).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) >= max(need[i], need[j])}
    assert want <= got


def test_title_pairs_by_brute_force(spark):
    titles = titles_of(random.Random(4), 160) + ["the quick brown fox jumps", "quick brown fox jumps", "tge quick brown fox jumps", "y" * 150 + "quickbrownfoxjumps" + "y" * 150, "q" * 30_000]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string").repartition(4)
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(normal(t), i)
    want = {}
    for x, i in first.items():
        for y, j in first.items():
            if i < j and (value := similar(x, y)) >= 0.85:
                want[i, j] = value
    got = {(r["a"], r["b"]): r["similarity"] for r in events.title_pairs(df, "id", "t").collect()}
    assert got == want and len(got) > 20
    classes = {r["id"]: r["class"] for r in events.title_classes(df, "id", "t").collect()}
    assert classes == {i: first[normal(t)] for i, t in enumerate(titles)}
    assert events.title_pairs(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError, match="5/6"):
        events.title_pairs(df, "id", "t", 0.8)


def test_pool_matches_and_single_use(spark):
    """All three tests over all pairs; then the walk in which a signal that is taken in takes in none."""
    rng = random.Random(6)
    titles = titles_of(rng, 60)
    summaries = ["Jeff Dean opens the Discovery Loop lab", "why Jeff Dean left Discovery Loop", None, "", "Geneva summit opens with quantum chips", "quantum chips summit in Geneva opens"]
    items = [(i, t, rng.choice(summaries), rng.choice([None, 0, 2 * DAY, 5 * DAY])) for i, t in enumerate(titles)]

    def context(a, b):
        x, y = (anchors(f"{i[1] or ''} {i[2] or ''}") for i in (a, b))
        shared, common = len(names(set(x) & set(y))), len(near(x) & near(y))
        close = a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 3 * DAY
        return close and (common >= 2 and shared >= 2 or common >= 1 and shared >= 4)

    match = {(a[0], b[0]) for a in items for b in items if a[0] != b[0] and (same(a[1], b[1], 0.85) or context(a, b))}
    df = spark.createDataFrame(items, "id long, t string, s string, ms long")
    signals = df.where("id % 2 = 0")
    got = {(r["signal_id"], r["pool_id"]) for r in events.pool_matches(signals, df, "id", "t", "s", "ms").collect()}
    assert got == {p for p in match if p[0] % 2 == 0}
    taken, shown = {}, []
    for a in items:
        if a[0] not in taken:
            shown.append(a[0])
            for b in items:
                if b[0] not in taken and b[0] not in shown and (a[0], b[0]) in match:
                    taken[b[0]] = a[0]
    found = events.consume_once(events.pool_matches(df, df, "id", "t", "s", "ms"), df.select("id", F.col("id").alias("place")))
    assert {r["id"]: r["taken_by"] for r in found.collect()} == {i[0]: taken.get(i[0]) for i in items}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_nearest_by_brute_force(spark, block):
    rng = random.Random(block)
    texts = [rng.choice(titles_of(rng, 20)) for _ in range(40)] + ["Long text " * 300, None, " "]
    short = [re.sub(r"\s+", " ", (t or "").lower())[:800] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["similarity"] for r in social.nearest(df.where("id % 5 = 0 OR id > 38"), df, block).collect()}
    for i, similarity_of in got.items():
        others = [SequenceMatcher(None, short[i], t).ratio() for j, t in enumerate(short) if j != i and t]
        assert similarity_of == (max(others) if short[i] else None), i


def test_best_members(spark):
    rows = spark.createDataFrame([("d", 1, 1, 5, 0), ("d", 1, 2, 9, 0), ("d", 1, 3, 9, 0), ("d", 4, 4, None, 0), ("e", 1, 1, 1, 0)], "day string, event int, n int, points int, members_before int")
    got = {(r["day"], r["n"]): (r["is_best"], r["members"]) for r in events.best_members(rows, ["day"], F.col("points"), ["n"]).collect()}
    assert got == {("d", 1): (False, 3), ("d", 2): (True, 3), ("d", 3): (False, 3), ("d", 4): (True, 1), ("e", 1): (True, 1)}
