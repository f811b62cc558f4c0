"""What the findings of round 4 named, each on a small input."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from briefloom import storage
from briefloom.operators import events, pairs
from briefloom.plans import relational, views
from tests.test_same_event import DAY, anchors, names, near, same, titles_of

SUMMARIES = ["Jeff Dean opens the Discovery Loop lab", "why Jeff Dean left Discovery Loop", None, "", "Geneva summit opens with quantum chips", "quantum chips summit in Geneva opens"]


def rows_written(monkeypatch, folder, run):
    """The result of ``run`` and the rows of all tables that it wrote on its way."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"file://{folder}")
    found = run()
    return found, sum(pq.read_metadata(file).num_rows for file in Path(folder).rglob("*.parquet"))


def context(a, b):
    x, y = (anchors(f"{i[2] or ''} {i[3] or ''}") for i in (a, b))
    shared, common = len(names(set(x) & set(y))), len(near(x) & near(y))
    close = a[4] is None or b[4] is None or abs(a[4] - b[4]) <= 3 * DAY
    return close and (common >= 2 and shared >= 2 or common >= 1 and shared >= 4)


def walked(items):
    """Who takes whom in, by the walk over all pairs of signals (id, place, title, summary, ms)."""
    taken, shown = {}, []
    for a in sorted(items, key=lambda i: (i[1] is not None, i[1] or 0, i[0])):
        if a[0] not in taken:
            shown.append(a[0])
            for b in items:
                if b[0] not in taken and b[0] not in shown and (same(a[2], b[2], 0.85) or context(a, b)):
                    taken[b[0]] = a[0]
    return {i[0]: taken.get(i[0]) for i in items}


@pytest.mark.parametrize(("first", "seed"), [(3, 1), (10_000, 2)])
def test_signals_are_taken_in_as_the_walk_takes_them(spark, first, seed):
    """in one batch and in many, with missing titles, times and places, and with the order of places not that of ids."""
    rng = random.Random(seed)
    items = [(i, rng.choice([None, rng.randrange(60)]) if i % 9 == 0 else rng.randrange(60), t, rng.choice(SUMMARIES), rng.choice([None, 0, 2 * DAY, 5 * DAY, -4 * DAY])) for i, t in enumerate(titles_of(rng, 60))]
    df = spark.createDataFrame([*items, (None, 1, "no id", "", 0)], "id long, p long, t string, s string, ms long")
    got = [(r["id"], r["taken_by"]) for r in events.taken_in(df, "id", "p", "t", "s", "ms", first=first).collect()]
    want = walked(items)
    assert len(got) == len(items) + 1 and dict(got) == want | {None: None} and 20 < len([t for t in want.values() if t is not None]) < 60


def test_the_matches_of_one_event_are_not_listed(spark, tmp_path, monkeypatch):
    """disk grew with the square of an event's pages, as all of their matches were written, and some of them once a round."""
    rng = random.Random(4)
    other = lambda: " ".join("".join(rng.choice("abdegiklmnorstu") for _ in range(7)) for _ in range(6))
    pages = [("The summit of the year", f"dean opens the discovery loop lab {i}") if i % 2 else (other(), other()) for i in range(400)]
    rows = [(i, "u", f"<title>{title}</title><p>{text}</p>") for i, (title, text) in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (tmp_path / "shared").mkdir()
    found, n = rows_written(monkeypatch, tmp_path / "shared", lambda: relational.consume_once(spark, str(tmp_path)).collect())
    matches = events.pool_matches(*[relational.titled_pages(spark, str(tmp_path))] * 2, "page_id", "title", "summary", "published_ms")
    order = spark.range(400).select("id", F.col("id").alias("place"))
    assert sorted(map(tuple, found)) == sorted(map(tuple, events.consume_once(matches, order).collect()))
    assert sum(r["taken_by"] == 1 for r in found) == 199 and n < 40 * 400 < matches.count()


@pytest.mark.parametrize("block", [2, 32_768])
def test_contexts_meet_in_spans_of_time(spark, block):
    """each pair once, or the first for each, whatever spans, missing times, blocks and titles they have."""
    rng = random.Random(block)
    words = [[rng.choice(["dean", "loop", "lab", "acme", "opus", "rises", "geneva"]) for _ in range(rng.choice([2, 6, 9]))] for _ in range(40)]
    stamps = [rng.choice([None, -5, -1, 0, 3, 4, 9, 14]) for _ in words]
    titles = [rng.choice([0, 0, 1, 2]) for _ in words]

    def matches(a, b):
        shared, common = len(names(words[a]) & names(words[b])), len(near(words[a]) & near(words[b]))
        close = stamps[a] is None or stamps[b] is None or abs(stamps[a] - stamps[b]) <= 4
        return close and (titles[a] == 0 or titles[a] != titles[b]) and (common >= 2 and shared >= 2 or common >= 1 and shared >= 4)

    code = lambda x: hash(x) & (1 << 60) - 1
    rows = [(i, stamps[i], titles[i], [code(x) for x in near(w)], [code(x) for x in names(w)], rng.choice([None, 3, 30])) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "n long, ms long, title long, pairs array<long>, names array<long>, bound long")
    got = sorted(map(tuple, pairs.near_contexts(df.drop("bound"), None, 4, block).collect()))
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if matches(a, b)] and len(got) > 30
    first = {}
    for r in pairs.near_contexts(df.where("n < 15").drop("bound"), df.where("n >= 15"), 4, block).collect():
        first[r["late"]] = min(r["early"], first.get(r["late"], 40))
    met = {b: [a for a in range(15) if matches(a, b) and (rows[b][5] is None or a < rows[b][5])] for b in range(15, 40)}
    assert first == {b: min(a) for b, a in met.items() if a} and len(first) > 3


def test_pairs_of_entities_are_made_in_many_tasks(spark, tmp_path):
    """few bytes make many pairs, which adaptive plans put into few tasks, and words were cut out of their texts again for each step."""
    rng = random.Random(7)
    words = [["src1", "acme", "opus", "rises"], ["src1", "acme", "opus"], ["src1", "acme", "opus", "rises", "again"], ["src2", "acme", "opus"], ["acme", "opus"]]
    rows = [(i, rng.choice(words)) for i in range(150)]
    path = str(tmp_path / "items")
    spark.createDataFrame(rows, "id long, words array<string>").write.parquet(path)
    found = events.entity_pairs(spark.read.parquet(path), 8)
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert not any(path in file for file in found.inputFiles())
    want = [(a, b) for a, x in rows for b, y in rows if a < b and "src1" in x and "src1" in y or a < b and x == y == words[3]]
    assert sorted(map(tuple, found.collect())) == want


def test_entries_without_their_texts(spark, tmp_path):
    """whole texts went through the join with the events where a query needs their first lines."""
    spark.createDataFrame([(1, "one. two\nthree", "en", "src3", 1), (2, None, "en", "src4", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 7, "view", 1.0), (2, 7, "view", 1.0)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    cut = views.entries(spark, str(tmp_path), F.substring_index("text", "\n", 1))
    assert cut.drop("body").exceptAll(views.entries(spark, str(tmp_path)).drop("body")).isEmpty()
    plan = cut.select("doc_id", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index(text" in plan.split("Join", 1)[1]
