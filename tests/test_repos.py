import random

from pyspark.sql import functions as F

from briefloom.operators import repos

DAY, NOW = 86_400_000, 1_706_659_200_000
SCHEMA = "ord int, full_name string, description string, topics array<string>, language string, stars long, forks long, created_ms long, pushed_ms long, score_before int"


def repo(ord, name, stars=5000, forks=100, age=900, pushed=1, topics=("llm",), language="Python", description=""):
    return (ord, name, description, None if topics is None else list(topics), language, stars, forks, None if age is None else NOW - age * DAY, None if pushed is None else NOW - pushed * DAY, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def entry(title, updated="2024-01-20T00:00:00Z", link="", content=""):
    return f"<entry><id>x</id><title>{title}</title><updated>{updated}</updated>{link}<content type='html'>{content}</content></entry>"


def test_pool_takes_the_first_row_of_the_first_route(spark):
    a, b = frame(spark, [repo(2, "x", stars=2), repo(1, "x", stars=1), repo(3, "", stars=3), repo(4, None)]), frame(spark, [repo(0, "x", stars=9), repo(5, "y")])
    assert {(r["full_name"], r["stars"], r["route"]) for r in repos.pool(a, b, "ord").collect()} == {("x", 1, 0), ("y", 5000, 1)}


def test_thresholds_and_words(spark):
    rows = [
        repo(1, "a/kept"), repo(2, "a/few-stars", stars=1999), repo(3, "a/new", stars=500, forks=20, age=30), repo(4, "a/new-no-forks", stars=9000, forks=19, age=3), repo(5, "a/awesome-x"), repo(6, "a/book", topics=["LLM", "Books"]),
        repo(7, "a/off", topics=["web"]), repo(8, "a/off-but-said", topics=None, description="An Agent"), repo(9, "a/no-age", age=None, pushed=None, stars=None), repo(10, "a/sdk", description="unofficial SDK for x"), repo(11, "a/c", language="C"), repo(12, "a/nolang", language=""),
    ]
    got = {r["ord"]: (r["is_new"], r["score"]) for r in repos.scored(frame(spark, rows), repos.RepoRules(NOW)).collect()}
    assert set(got) == {1, 3, 8, 10, 11, 12} and [k for k, v in got.items() if v[0]] == [3]
    assert round(got[1][1] - got[10][1], 6) == 0.5 == round(got[1][1] - got[8][1], 6)
    chosen = repos.scored(frame(spark, rows), repos.RepoRules(NOW, languages=("python",)))
    assert {r["ord"] for r in chosen.collect()} == {1, 3, 8, 10, 12}


def test_release_states(spark):
    feeds = {
        "none": None, "blank": "", "empty": "<feed></feed>", "only early": "<feed>" + entry("v1.0rc1") + entry("2.0-beta") + entry("v3 nightly"), "second": "<feed>" + entry("v0.26.1rc0") + entry(" Prelude\n 1 ", link='<link rel="a" href="https://e.org/r"/>') + entry("v0"),
        "untimed": "<feed><entry><title>v9</title></entry>" + entry("v8", " 2024-01-02 "), "late time": "<feed><entry><title>v9</title>" + "x" * 4000 + "<updated>2024</updated></entry>" + entry("v7"),
        "long": "<feed>" + entry("v1.dev1") * 12_000 + entry("v5"),
    }
    rows = spark.createDataFrame(list(feeds.items()), "name string, feed string").select("name", repos.latest_release(F.col("feed")).alias("r"))
    got = {r["name"]: None if r["r"] is None else tuple(r["r"]) for r in rows.collect()}
    when = "2024-01-20T00:00:00Z"
    assert got == {"none": None, "blank": None, "empty": (None, None, None), "only early": (None, None, None), "second": ("Prelude 1", when, "https://e.org/r"), "untimed": ("v8", "2024-01-02", None), "late time": ("v7", when, None), "long": ("v5", when, None)}


def test_list_by_a_walk(spark):
    """The walk in order of points, with its quotas, against the joins and limits."""
    rng = random.Random(5)
    rules = repos.RepoRules(NOW, most=12)
    rows = [repo(i, f"o/r{i:03d}", stars=rng.choice([2500, 4000, 90_000]), forks=rng.choice([20, 400]), age=rng.choice([2, 29, 31, 500])) for i in range(150)]
    ages = {i: rng.choice([None, "", "stale", 3, 30, 31]) for i in range(150)}
    text = lambda a: a if a in (None, "") else "<feed>" + (entry("v1-rc.1") if a == "stale" else entry("v1", f"2024-01-{31 - a:02d}T00:00:00Z" if a < 31 else "2023-12-30T23:59:59Z"))
    feeds = spark.createDataFrame([(f"o/r{i:03d}", text(a)) for i, a in ages.items() if i % 11], "full_name string, feed string")
    scored = repos.scored(frame(spark, rows), rules)
    ranked = [(r["ord"], r["is_new"]) for r in scored.orderBy(F.desc("score"), F.desc("stars"), "ord").collect()]
    want, fresh, asked = [], 0, 0
    for i, is_new in ranked:
        if len(want) >= rules.most:
            break
        if is_new:
            if fresh < rules.most_new:
                fresh += 1
                want.append(f"o/r{i:03d}")
        elif asked < rules.most_lookups:
            asked += 1
            if i % 11 and ages[i] in (3, 30):
                want.append(f"o/r{i:03d}")
    out = repos.repository_items(scored, feeds, rules, "ord").orderBy("nth").collect()
    assert [r["full_name"] for r in out] == want and any(r["is_new"] for r in out) and not all(r["is_new"] for r in out)
    old = next(r for r in out if not r["is_new"])
    assert old["title"] == f"{old['full_name']} v1" and old["url"] == f"https://github.com/{old['full_name']}" and old["event"].startswith("🚀 新版本 v1｜发布于 2024-01-")
    assert repos.repository_items(scored.limit(0), feeds, rules, "ord").count() == 0
