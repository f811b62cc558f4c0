import json
import random

from pyspark.sql import functions as F

from briefloom.config import EngineConfig, Quotas
from briefloom.operators import briefs, clean, events, reports, select, social, typed
from briefloom.sources import sinks
from briefloom.streaming import incremental

NOW = 1_706_659_200_000
HOUR = 3_600_000
ITEM = "title string, url string, body string, published_ms long, heat_keep boolean, fetch_method string, lookback_hours int, keyword_regex string, keyword_min_hits int, title_exclude_regex string, min_content_chars int, key string, feed string, ord int"


def item(ord, title="AI news", url="https://e.org/1", body="ai " * 60, published=NOW - HOUR, hot=False, method="RSS", hours=24, exclude="", least=0, key=None, feed="f"):
    return (title, url, body, published, hot, method, hours, "", 1, exclude, least, key or str(ord), feed, ord)


def test_funnel_reasons_in_order(spark):
    rows = [
        item(1), item(2, title="<b></b>"), item(3, exclude="news"), item(4, published=None), item(5, published=NOW - 24 * HOUR), item(6, published=NOW - 24 * HOUR + 1),
        item(7, published=NOW - 99 * HOUR, hot=True), item(8, body="ai", url="ftp://x"), item(9, body="ai"), item(10, title="x", body="nothing here " * 20), item(11, key="1"), item(12, key=""), item(13, key=""),
    ]
    out = clean.clean(spark.createDataFrame(rows, ITEM), EngineConfig(now_ms=NOW, kept_per_feed=5), "key", "feed", ["ord"])
    got = {r["ord"]: r["drop_reason"] for r in out.collect()}
    want = {1: None, 2: "missing_title_url", 3: "title_exclude_regex", 4: "missing_or_invalid_date", 5: "lookback", 6: None, 7: None, 8: "min_content_chars", 9: None, 10: "keyword_regex", 11: "dup_round", 12: None, 13: "per_feed_cap"}
    assert got == want
    assert {r["ord"] for r in out.where("window_only").collect()} == {5} and {r["ord"] for r in out.where("needs_fulltext AND drop_reason IS NULL").collect()} == {9}
    assert out.limit(0).transform(clean.funnel).count() == 0


def test_blank_keys_are_new(spark):
    items = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "key string")
    assert sorted(str(r["key"]) for r in clean.new_items(items, spark.createDataFrame([("a",), ("",)], "key string"), "key").collect()) == ["", "None", "b"]


def test_typed_filter_order_and_falsy_thresholds(spark):
    rows = spark.range(1).withColumn("text", F.lit("body with the word"))
    reason = lambda params, metrics, entity="video": rows.select(typed.typed_reason(F.lit(entity), {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in params.items()}, {k: F.lit(v) for k, v in metrics.items()}, F.col("text"), F.length("text")).alias("r")).first()["r"]
    assert reason({}, {}) is None and reason({"min_views": 0}, {"views": -1}) is None and reason({"min_views": 5}, {}) is None
    assert reason({"min_views": 5, "keyword_exclude": ["word"]}, {"views": 1}) == "keyword_exclude" and reason({"min_views": 5}, {"views": 1}) == "min_views"
    assert reason({"min_followers": 5}, {"followers": 1}, "social") is None and reason({"require_community_heat": True}, {}) == "require_community_heat"
    assert reason({"require_community_heat": True}, {"accepted_venue": "ICML"}) is None and reason({"require_code": True}, {"has_code": False}) == "require_code"


def brute_pick(pool, quotas):
    order = sorted(pool, key=lambda i: (select.PRIORITY_RANK.get(i["priority"], 3), -i["quality"] * (0.7 if i["is_arxiv"] else 1), -i["published_ms"], i["doc_id"]))
    return [order[i]["doc_id"] for i in select.pick(order, quotas, sum(i["priority"] != "P0" for i in pool))]


def test_reduced_pool_gives_the_same_selection(spark):
    rng = random.Random(5)
    kinds = ["论文", "视频", "播客", "Github热榜", "文章"]
    for n, quotas in ((400, Quotas()), (200, Quotas(total=7, per_source=1)), (3, Quotas())):
        pool = [{"doc_id": i, "source_id": f"s{rng.randrange(12)}", "priority": rng.choice(["P0", "P0", "P1", "P2"]), "content_type": rng.choice(kinds), "is_arxiv": rng.random() < 0.3, "quality": float(rng.randrange(20)), "published_ms": rng.randrange(50)} for i in range(n)]
        df = spark.createDataFrame([tuple(p.values()) for p in pool], "doc_id long, source_id string, priority string, content_type string, is_arxiv boolean, quality double, published_ms long")
        got = [r["doc_id"] for r in select.select_candidates(df, quotas).orderBy("pick").collect()]
        assert got == brute_pick(pool, quotas)


def test_each_quota_binds():
    base = {"content_type": "文章", "is_arxiv": False, "priority": "P1"}
    for change, limit in (({"content_type": "论文"}, 4), ({"content_type": "Github热榜"}, 5), ({"is_arxiv": True}, 10), ({"source_id": "one"}, 4), ({"priority": "P0"}, 30)):
        pool = [base | {"source_id": f"s{i}"} | change for i in range(40)]
        assert len(select.pick(pool, Quotas(), 0)) == limit
    assert len(select.pick([base | {"source_id": f"s{i}", "priority": "P0"} for i in range(40)], Quotas(), 20)) == 22


def test_least_videos_keep_rank_order(spark):
    ranked = spark.createDataFrame([(i, "视频" if i in (8, 9) else "文章") for i in range(1, 11)], "rk int, kind string")
    out = select.balance(ranked, 4, F.col("kind") == "视频", 1, "rk").orderBy("place").collect()
    assert [r["rk"] for r in out] == [1, 2, 3, 8]


def test_patterns_of_items_are_tested_where_they_run(spark):
    """A pattern that does not compile counts as none, also where no one has looked at the feeds before."""
    rows = [item(1)[:7] + ("(?P<x>news)", 1, "[bad(", 0, "1", "f", 1), item(2)[:7] + ("*", 1, "(?P<y>news)", 0, "2", "f", 2)]
    out = clean.tag_reasons(spark.createDataFrame(rows, ITEM), EngineConfig(now_ms=NOW)).collect()
    assert {r["ord"]: r["drop_reason"] for r in out} == {1: None, 2: "title_exclude_regex"}


def test_same_event_titles(spark):
    pairs = [("Introducing Acme Opus 5", "Acme Opus 5 来了"), ("Quantum chips get cheaper", "Quantum chips get cheaper!"), ("Acme Opus 5", "Acme Sonnet 5"), ("Optimization", "On the optimization of very large systems"), ("Summit 2026 day one", "Summit 2026 day two recap of robots"), ("", "x"), ("", "")]
    rows = spark.createDataFrame([(i, j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "day int, n int, t string")
    out = {(r["day"], r["n"]): r["event"] for r in events.cluster(rows, ["day"], "t", ["n"]).collect()}
    assert [out[i, 1] for i in range(len(pairs))] == [0, 0, 1, 1, 1, 1, 1]
    more = spark.createDataFrame([(1, i, t) for i, t in enumerate(("Acme Opus 5 out", "else entirely", "Acme Opus 5 out now"))], "day int, n int, t string")
    assert [r["event"] for r in events.cluster(more, ["day"], "t", ["n"]).orderBy("n").collect()] == [0, 1, 0]


def test_events_groups_and_matches(spark):
    rows = spark.createDataFrame([("d", "s1", "https://e.org/A/", "官方来源", 1), ("d", "S1", "https://e.org/a", "官方来源", 2), ("d", "s2", "", "相关报道", 3), ("d", "s3", "https://e.org/a", "相关报道", 4)], "day string, source string, url string, grp string, ord int")
    out = {r["grp"]: r["n"] for r in events.group_members(rows, ["day"], "source", "url", "grp", ["ord"]).collect()}
    assert out == {"官方来源": 1, "相关报道": 1}
    signals = spark.createDataFrame([(1, "Jeff Dean opens Discovery Loop lab", 0), (2, "Discovery Loop: why Jeff Dean left", 1), (3, "Discovery Loop: why Jeff Dean left", 9 * 86_400_000), (4, "other", None)], "id long, t string, ms long").withColumn("s", F.lit(""))
    found = {(r["signal_id"], r["pool_id"]) for r in events.pool_matches(signals.where("id = 1"), signals, "id", "t", "s", "ms").collect()}
    assert found == {(1, 2)}
    taken = events.consume_once(events.pool_matches(signals, signals, "id", "t", "s", "ms"), signals.select("id", F.col("id").alias("place")))
    assert {r["id"]: r["taken_by"] for r in taken.collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_social(spark):
    near = social.nearest(spark.createDataFrame([(1, "abcd"), (2, None)], "id long, text string"), spark.createDataFrame([(7, "abcx"), (8, "zzzz"), (9, None)], "id long, text string"), block=1)
    assert {r["id"]: r["similarity"] for r in near.collect()} == {1: 0.75, 2: None}


def test_reports_and_briefs(spark):
    entries = spark.createDataFrame([("a", 5), ("a", 7), ("x", 1)], "source_id string, ms long")
    out = {r["source_id"]: (r["n"], r["in_param"], round(r["share"], 2)) for r in reports.contribution(entries, spark.createDataFrame([("a",), ("b",)], "source_id string"), "source_id", "ms").collect()}
    assert out == {"a": (2, True, 66.67), "b": (0, True, 0.0), "x": (1, False, 33.33)}
    stored = spark.createDataFrame([("d1", "old", "已发送")], "date string, title string, send_status string")
    fresh = spark.createDataFrame([("d1", "new"), ("d2", "first")], "date string, title string")
    assert {tuple(r) for r in briefs.upsert_briefs(stored, fresh).collect()} == {("d1", "new", "已发送"), ("d2", "first", "待发送")}
    inside = spark.createDataFrame([(NOW - 23 * HOUR, 24), (NOW - 25 * HOUR, 24), (NOW - 999 * HOUR, None), (None, None)], "p long, h int")
    assert [r[0] for r in inside.select(briefs.in_brief_window(F.col("p"), F.lit(NOW), F.col("h"))).collect()] == [True, False, True, False]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "My Source"), (2, "my source!"), (3, "来源")], "id int, name string")
    assert sinks.seed(spark, rows, path) and not sinks.seed(spark, rows, path)
    assert [r["slug"] for r in sinks.unique_slugs(rows, "name", "id").orderBy("id").collect()] == ["my-source", "my-source-2", "source"]
    insert, update = sinks.split_for_upsert(rows, rows.where("id = 1"), "id")
    assert insert.count() == 2 and update.count() == 1
    grown = sinks.with_columns_of(rows, spark.createDataFrame([], "id int, more string").schema)
    assert set(grown.columns) == {"id", "name", "more"}


def test_upserting_sink_may_be_repeated(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    sink = incremental.upserting(path, "k", "at")
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string")
    sink(one, 0)
    sink(spark.createDataFrame([(1, 2, "c")], "k int, at int, v string"), 1)
    sink(spark.createDataFrame([(1, 2, "c")], "k int, at int, v string"), 2)
    assert {(r["k"], r["v"]) for r in incremental.read_upserted(spark, path).collect()} == {(1, "c"), (2, "b")}
    restarted = incremental.upserting(path, "k", "at")  # a new checkpoint counts its batches from 0 again
    for _ in range(2):
        restarted(spark.createDataFrame([(9, 3, "d")], "k int, at int, v string"), 0)
    assert {(r["k"], r["v"]) for r in incremental.read_upserted(spark, path).collect()} == {(1, "c"), (2, "b"), (9, "d")}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_drained_streams_leave_no_rows_in_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string").repartition(2).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
    out = incremental.drain(source, "drained")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b"), (2, "b")] and out.columns == ["k", "v"]
    assert out.inputFiles() and not spark.catalog.tableExists("drained")
    counts = incremental.drain(source.groupBy("k").count(), "counted", "update")
    assert sorted(map(tuple, counts.collect())) == [(1, 1), (2, 2)]
    (tmp_path / "none").mkdir()
    assert incremental.drain(spark.readStream.schema("k long").parquet(f"{tmp_path}/none"), "none").count() == 0
