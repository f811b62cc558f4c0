import random
from datetime import datetime, timedelta

from briefloom.operators import social
from briefloom.streaming import incremental

COUNTS = ["likes", "replies", "reposts", "quotes", "bookmarks"]
SCHEMA = "conversation_id string, id long, text string, created_at string, refs array<string>, edits array<string>, " + ", ".join(f"{c} long" for c in COUNTS) + ", title string"


def brute(posts):
    groups = {}
    for p in posts:
        if key := p[0] or (str(p[1]) if p[1] is not None else ""):
            groups.setdefault(key, []).append(p)
    out = {}
    for key, rows in groups.items():
        rows.sort(key=lambda p: p[1])
        texts = [t for p in rows if (t := (p[2] or "").strip())]
        if not texts:
            continue
        root = next((p for p in rows if str(p[1]) == key), rows[0])
        line = " ".join(texts[0].split())
        kinds = {k for p in rows for k in p[4] or []}
        sums = [sum(p[6 + i] or 0 for p in rows) for i in range(5)]
        first = root[5][0] if root[5] and root[5][0] else str(root[1])
        out[key] = (line[:117] + ("..." if len(line) > 117 else ""), "\n\n---\n\n".join(texts), len(rows), root[1], root[3], first, "retweeted" in kinds, "replied_to" in kinds, "quoted" in kinds, *sums, sums[0] + 2 * sum(sums[1:4]) + sums[4])
    return out


def test_threads_by_their_definition(spark):
    rng = random.Random(8)
    texts = [" a ", "b\n\n c", "", "  ", None, "　wide　", "word " * 60, "last"]
    posts = []
    for i in range(400):
        key = rng.choice([None, "", *[str(k) for k in range(40)]])
        posts.append((key, i, rng.choice(texts), f"day {i}", rng.choice([None, [], ["quoted"], ["replied_to", "retweeted"]]), rng.choice([None, [], [""], [str(i - 1), str(i)]]), *[rng.choice([None, 0, 3]) for _ in COUNTS], "clash"))
    df = spark.createDataFrame(posts, SCHEMA).repartition(3)
    out = social.merge_threads(df, "conversation_id", "id", "text", created="created_at", references="refs", edits="edits", sums=COUNTS)
    names = ["title", "body", "thread_count", "root_id", "published_raw", "canonical_id", "is_retweet", "is_reply", "is_quote", *COUNTS, "engagement"]
    assert {r["conversation_id"]: tuple(r[n] for n in names) for r in out.collect()} == brute(posts)
    assert social.merge_threads(df.limit(0), "conversation_id", "id", "text").count() == 0


def test_root_and_rule(spark):
    posts = spark.createDataFrame([(1, 2, " a "), (1, 1, ""), (1, 3, "b"), (3, 4, "c"), (3, 3, "d")], "conv long, n int, t string")
    got = {r["conv"]: (r["body"], r["root_id"], r["thread_count"]) for r in social.merge_threads(posts, "conv", "n", "t").collect()}
    assert got == {1: ("a\n\n---\n\nb", 1, 3), 3: ("d\n\n---\n\nc", 3, 2)}


def test_quiet_threads_over_batches(spark, tmp_path):
    """Files arrive one a batch; threads come out once, late posts make rows that merge, and little state stays."""
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [(1, at(0), 1, "a"), (1, at(20), 2, "b"), (2, at(5), 3, "x")],
        [(1, at(10), 4, "between"), (2, at(100), 5, "y"), (None, at(100), 6, "none"), (3, None, 7, "no time")],
        [(3, at(300), 8, "z"), (2, at(290), 9, "late but in time")],
        [(4, at(900), 11, "end")],
        [(1, at(30), 10, "behind the watermark"), (4, at(901), 12, "still open")],
    ]
    place = f"{tmp_path}/in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "conv long, ts timestamp, n int, t string").coalesce(1).write.mode("append").parquet(f"{place}/b={k}")
    stream = spark.readStream.schema("conv long, ts timestamp, n int, t string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{place}/b=*")
    out = incremental.quiet_threads(stream, "conv", "ts", "n", "t", "60 minutes", "30 minutes")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    query = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    rows = spark.read.parquet(f"{tmp_path}/out")
    got = sorted((r["conv"], [p["place"] for p in r["posts"]]) for r in rows.collect())
    assert got == [(1, [1, 2, 4]), (2, [3]), (2, [5]), (2, [9]), (3, [8])]
    assert sizes[-1] <= 2
    merged = {r["conv"]: [p["place"] for p in r["posts"]] for r in incremental.merge_sessions(rows.drop("batch"), "conv").collect()}
    assert merged == {1: [1, 2, 4], 2: [3, 5, 9], 3: [8]}
