"""What the findings of round 3 named, each on a small input."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from briefloom.functions import scoring, similarity
from briefloom.operators import events, pairs
from briefloom.plans import scalars


def saved(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS = "event_id long, user_id long, event_type string, value double"


def test_a_quality_just_below_the_threshold_is_not_high(spark, tmp_path):
    """49.96 is shown as 50.0, and is not 50."""
    venue = 6120 % 101
    signal = (49.96 * 0.75 - 0.40 * venue) / 0.35
    d = saved(spark, tmp_path, documents=([(6120, "a", "en", "src1", 1)], DOCUMENTS), events=([(6120, 1, "view", signal)], EVENTS))
    row = scalars.quality_score(spark, d).first()
    value = (0.40 * venue + 0.35 * signal) / 0.75
    assert 49.95 <= value < 50 and row["high"] is False
    shown = spark.range(1).select(scoring.quality(F.lit(float(venue)), F.lit(0.0), F.lit(signal), F.lit(False)).alias("q")).first()["q"]
    assert shown == 50.0


@pytest.mark.parametrize("cell", [3, 512])
def test_entities_of_many_copies(spark, cell):
    """copies are one class that is tested once, and all of their pairs are there, whatever block they are in."""
    texts = ["src1 acme opus rises", "src1 acme opus rises again", "src1", "src2 acme opus rises", "src1 acme opus", "acme opus rises", "src1 acme src1 acme"]
    words = {i: (texts * 4 + [texts[0]] * 30)[i].split() for i in range(58)}
    near = lambda w: set(zip(w, w[1:]))

    def same(x, y):
        shared = set(x) & set(y)
        return {"acme", "opus", "rises", "again"} & shared and {"src1", "src2"} & shared and near(x) & near(y) and len(shared) >= 0.55 * len(set(x) | set(y))

    want = sorted((i, j) for i in words for j in words if i < j and same(words[i], words[j]))
    df = spark.createDataFrame(list(words.items()), "id long, words array<string>")
    assert sorted((r["a"], r["b"]) for r in events.entity_pairs(df, cell).collect()) == want and len(want) > 500


@pytest.mark.parametrize("block", [7, 8192])
def test_titles_that_share_their_letters_are_few_candidates(spark, block):
    """titles of few syllables share pairs of letters, not the order of their letters; no pair of a ratio of .85 is lost."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the", "re", "on", "tion", "an", "ing", "st", "ou"]) for _ in range(18)) for _ in range(60)]
    texts += [t[:k] + "x" + t[k + 2 :] + "y" * n for t in texts[:20] for k, n in ((5, 0), (30, 2))] + ["z" * 300, "z" * 290 + "ab", "q" * 70 + texts[0], "q" * 70 + texts[0] + "r"]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "grp int, id long, t string")
    got = {(r["a"], r["b"]) for r in pairs.alike_titles(df, 0.85, block).collect()}
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio()) >= 0.85}
    assert want <= got and 60 < len(want) and len(got) <= len(want) + 40


@pytest.mark.parametrize("block", [5, 16_384])
def test_contexts_meet_by_pairs_in_cells(spark, block):
    """contexts of common words, each pair once, with the times that rule pairs out before their names are held together."""
    rng = random.Random(5)
    words = [[rng.choice(["dean", "loop", "lab", "acme", "opus", "rises", "geneva"]) for _ in range(rng.choice([2, 3, 6]))] for _ in range(40)]
    stamps = [rng.choice([None, 0, 4, 9]) for _ in words]
    near = lambda w: set(zip(w, w[1:]))
    names = lambda w: {x for x in w if len(x) >= 4}

    def matches(a, b):
        shared, common = len(names(words[a]) & names(words[b])), len(near(words[a]) & near(words[b]))
        close = stamps[a] is None or stamps[b] is None or abs(stamps[a] - stamps[b]) <= 4
        return close and (common >= 2 and shared >= 2 or common >= 1 and shared >= 4)

    df = spark.createDataFrame([(n, f"{n}-{i}", w, stamps[i], stamps[i]) for n in (0, 1) for i, w in enumerate(words)], "side int, class string, w array<string>, early long, late long")
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    df = df.select("side", "class", hashes(similarity.bigrams(F.col("w"))).alias("pairs"), hashes(F.array_distinct(F.filter("w", similarity.is_name))).alias("names"), "early", "late")
    got = sorted((r["signal"], r["pool"]) for r in pairs.shared_contexts(df, 4, block).collect())
    want = sorted((f"0-{a}", f"1-{b}") for a in range(40) for b in range(40) if matches(a, b))
    assert got == want and len(want) > 30


def test_paper_patterns_hit_at_every_letter_that_they_begin_with(spark):
    """the letters that a search is led by leave out no form of a pattern, in either case."""
    hits = (
        ["state-of-the-art", "SOTA"], ["benchmark", "Leaderboard"], ["open source", "released weights", "Release code"], ["foundation model", "large language model", "LLM", "multimodal", "agentic"],
        ["reasoning", "planning", "tool-use", "rlhf", "dpo", "GRPO", "moe"], ["outperform", "surpass", "beat", "improve over"], ["neurips", "iclr", "icml", "cvpr", "eccv", "acl", "emnlp", "aaai", "nature", "science", "jmlr"],
        ["lecture note", "homework", "coursework", "course project", "problem set", "tutorial slide"], ["undergraduate", "course project", "class project", "term paper"], ["retracted", "withdrawn", "duplicate submission"],
        ["position paper", "opinion", "perspective only"], ["preliminary", "work in progress", "extended abstract"],
    )
    assert all({w[0].lower() for w in words} == set(letters) for words, letters in zip(hits, scoring.PAPER_LETTERS, strict=True))
    words = [w for group in hits for w in group]
    texts = [f"a {w}, b" for w in words] + [f"x{w} x" for w in words] + [w.upper() for w in words]
    want = [max(0, min(100, 40 + sum(value for pattern, value in scoring.PAPER_POINTS if re.search(f"(?i){pattern}", t)))) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", scoring.paper_signal(F.col("t"), F.lit(""), F.lit("")).alias("s")).orderBy("i").collect()]
    assert got == want and len(set(want)) > 6
