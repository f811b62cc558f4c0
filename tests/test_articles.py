import json

import pytest
from pyspark.sql import functions as F

from briefloom.functions import article
from briefloom.operators import configs, media


@pytest.fixture()
def value(spark):
    """The value of a column expression on one row."""
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


BODY = "The model is out today, and it runs on one card."


@pytest.mark.parametrize(
    ("parts", "title", "want"),
    [
        (["A new model", "By Ann", "March 3, 2024", "5 min read", BODY], "A New Model!", [BODY]),
        (["Blog", BODY, "2024-03-03", "More of it follows here, with figures."], "", [BODY, "More of it follows here, with figures."]),
        (["Home", "Menu"], "", ["Home", "Menu"]),
        ([BODY, "x", "y", "2024-03-03"], None, [BODY, "x", "y", "2024-03-03"]),
        ([""], "t", [""]),
    ],
)
def test_drop_leading(value, parts, title, want):
    got = value(article.drop_leading(F.lit("\n\n".join(parts)), F.lit(title).cast("string")))
    assert got == "\n\n".join(want)


def test_drop_leading_of_null(value):
    assert value(article.drop_leading(F.lit(None).cast("string"), F.lit("t"))) == ""


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ([BODY, "Read more", BODY + " Yes."], [BODY, BODY + " Yes."]),
        ([BODY, BODY, BODY], [BODY]),
        ([BODY, "Products Research Company About", "© 2024 Acme. All rights reserved", "Cookies"], [BODY]),
        ([f"{BODY} {i}." for i in range(5)] + ["Card one", "What it says.", "Read more", "Card two", "What it says.", "Read more"], [f"{BODY} {i}." for i in range(5)]),
        (["Read more", "Read more", BODY], [BODY]),
        (["Cookies"], []),
        ([""], []),
    ],
)
def test_drop_labels(value, parts, want):
    assert value(article.drop_labels(F.lit("\n\n".join(parts)))) == "\n\n".join(want)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<meta property="og:image" content="/a.png?x=1&amp;y=2">', "https://e.org/a.png?x=1&y=2"),
        ("<META content='https://c.net/b.jpg' name='twitter:image'>", "https://c.net/b.jpg"),
        ('<meta property="og:image" content="/author-photo.png"><meta property="og:image" content="/c.png">', "https://e.org/c.png"),
        ('<meta property="og:image" content=""><meta property="og:title" content="/c.png">', ""),
        ("", ""),
    ],
)
def test_meta_cover(value, page, want):
    assert value(article.meta_cover(F.lit(page), F.lit("https://e.org/p/1"))) == want


@pytest.mark.parametrize(
    ("body", "source", "want"),
    [
        ("智东西 作者 | 张三 编辑 | 李四 今天发布了新模型。来源：某处 不变", "智东西", "今天发布了新模型。来源：某处 不变"),
        ("Source: a &amp; b&nbsp;c.  \n\n\n\n d", "", "Source: a & b c.\n\nd"),
        ("Text.\n\nThe post Text appeared first on Site.", "", "Text."),
        (None, "x", ""),
    ],
)
def test_clean_body(value, body, source, want):
    assert value(article.clean_body(F.lit(body).cast("string"), F.lit(source))) == want


def test_display_body(value):
    shown = lambda *a: tuple(value(article.display_body(*(F.lit(x).cast(t) for x, t in zip(a, ("string", "string", "int"), strict=True)))))
    assert shown("abcdef", "译", 3) == ("译", True)
    assert shown("abcdef", "译", 0) == ("译", False)
    assert shown("abcdef", None, None) == ("abcdef", False)
    assert shown(None, "", 1) == ("", False)


def test_compact_sections(value):
    long = "\n".join(f"## Part {i}\n" + f"Sentence {i} of it. " * 100 for i in range(8))
    got = value(article.compact_sections(F.lit(long), 1400))
    assert len(got) <= 1400 and [line for line in got.split("\n") if line.startswith("##")] == [f"## Part {i}" for i in range(6)]
    assert all(part.rstrip().endswith(".") for part in got.split("## ")[1:])
    assert value(article.compact_sections(F.lit("## A\nx"), 2)) == "## A\nx"
    assert value(article.compact_sections(F.lit("  ## A &amp; B\nx   y\n\nThe post A appeared first on B"), 2)) == value(article.clean_body(F.lit("  ## A &amp; B\nx   y\n\nThe post A appeared first on B"), F.lit("")))


def test_join_hyphens(value):
    assert value(article.join_hyphens(F.lit("mo-\ndel  run - \n x\n\n\n\ny"))) == "model run -\nx\n\ny"
    assert value(article.join_hyphens(F.lit("mo- \n del  run"), over_blanks=True)) == "model  run"
    assert value(article.join_hyphens(F.lit(None).cast("string"))) == ""


def test_topics(value):
    edge = lambda *a: value(article.is_edge_topic(*(F.lit(x).cast("string") for x in a)))
    assert edge("An on-device model", None, None) and edge("t", "手机端推理", "") and not edge("A model", "", "in the cloud")
    assert value(article.is_policy_document(F.lit("Whitehouse-Tech-1"), F.lit(True)))
    assert not value(article.is_policy_document(F.lit("whitehouse-tech-1"), F.lit(None).cast("boolean")))


def test_thread_media(spark):
    posts = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c", "a", ""]), (2, 1, []), (3, 1, ["z"])], "thread int, place int, media_keys array<string>")
    known = spark.createDataFrame([("a", "photo", "u1"), ("b", "video", "u2"), ("c", "photo", "u3")], "media_key string, type string, url string")
    rows = {r["thread"]: ([i["id"] for i in r["images"]], [(v["id"], v["url"]) for v in r["videos"]]) for r in media.thread_media(posts, known, "thread", "place").collect()}
    assert rows == {1: (["a", "c"], [("b", "u2")]), 3: ([], [("z", "")])}


def test_papers_and_index(spark):
    rows = [("p", 1, "A title", "", 3.0), ("p", 2, "", "2024-01-01", 9.0), ("p", 3, "ab", "2024-02-02", None), ("", 4, "Other", "", 1.0), ("q", 5, None, None, None)]
    merged = media.merged_papers(spark.createDataFrame(rows, "paper string, place int, title string, published string, upvotes double"))
    assert {r["paper"]: tuple(r)[1:] for r in merged.collect()} == {"p": ("A title", "2024-01-01", 9.0, 1), "q": (None, None, 0.0, 5)}
    episodes = spark.createDataFrame([("g", " l ", None, 1, [("t1",), ("",)]), ("g", "m", "l", 2, [("t2",)])], "guid string, link string, title string, place int, transcripts array<struct<url:string>>")
    assert {r["key"]: [t["url"] for t in r["transcripts"]] for r in media.transcript_index(episodes).collect()} == {"g": ["t2"], "l": ["t2"], "m": ["t2"]}


def test_enclosures_and_images(spark):
    schema = "own string, thumbs array<string>, feed string, enclosures array<struct<href:string,type:string,rel:string,length:long>>"
    rows = [("", ["", "t"], "f", [("x", "text/html", None, 1), ("y", "audio/mpeg", None, 2)]), (None, None, None, [("", "audio/mpeg", "enclosure", 1)])]
    got = spark.createDataFrame(rows, schema).select(media.entry_image(F.col("own"), F.col("thumbs"), F.col("feed")).alias("i"), media.audio_enclosure(F.col("enclosures"))["href"].alias("a")).collect()
    assert [tuple(r) for r in got] == [("t", "y"), ("", None)]


def test_analysis_valid(spark):
    rows = [("已分析", "s", "文章", None, True), ("已分析", "", "文章", None, False), ("待分析", "s", "文章", None, False), ("已分析", "s", "论文", "{}", False), ("已分析", "s", "论文", '{"llm": {"analysis_version": 2}}', True)]
    rows += [("已分析", "s", "文章", '{"full_text": {"source": "pdf", "version": 3}, "llm": {"evidence_version": 2}}', False), ("已分析", "s", None, "no json", True), (None, None, None, None, False)]
    table = spark.createDataFrame(rows, "status string, summary string, kind string, metrics string, want boolean")
    valid = configs.analysis_valid(F.col("status"), F.col("summary"), F.col("kind"), F.col("metrics"))
    assert table.where(~valid.eqNullSafe(F.col("want"))).count() == 0


def test_with_cached_computes_the_remainder_only(spark):
    items = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    cache = spark.createDataFrame([(1, "old", True), (2, "stale", False), (9, "other", True)], "id int, a string, ok boolean")
    got = configs.with_cached(items, cache, "id", F.col("ok"), lambda rest: rest.withColumn("a", F.lit("new")).withColumn("ok", F.lit(True)))
    assert {(r["id"], r["a"], r["cached"]) for r in got.collect()} == {(1, "old", True), (2, "new", False), (None, "new", False)}


def test_refresh_counts(spark):
    rows = configs.refreshed(spark.createDataFrame([("a", "b"), ("a", "a"), (None, "a")], "was string, now string"), "was", F.col("now"))
    assert {tuple(r) for r in configs.refresh_counts(rows, "was").collect()} == {("a", 2, 2, 1), ("b", 0, 1, 1), ("(empty)", 1, 0, 0)}


def test_papers_of_a_page(spark):
    """The list in an attribute, links and bare addresses; what does not parse costs nothing else."""
    props = lambda text: '<div data-target="DailyPapers"  data-props="' + text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;") + '">'
    one = {"dailyPapers": [{"title": " A <b>\n title ", "upvotes": 9, "paper": {"id": "2401.00001v2", "upvotes": 0, "publishedAt": "2024-01-30T00:00:00Z"}}, 7, {"paper": "x"}, {"paper": {"id": "2401.00002", "title": "Second", "upvotes": "many"}, "publishedAt": "2024-01-01"}, {"paper": {"id": "no id"}}]}
    html = props(json.dumps(one)) + props("{broken") + props('{"other": 1}') + "[Docs](https://huggingface.co/papers/2401.00001) [Named one](https://paperswithcode.com/papers/2401.00003v4) /papers/2401.00004 [x](https://e.org/a)"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    rows = media.paper_mentions(pages, "id", "html").orderBy("page", "place").collect()
    assert [(r["page"], r["paper"], r["title"], r["published"], r["upvotes"]) for r in rows[:4]] == [
        (1, "2401.00001", "A <b> title", "2024-01-30T00:00:00Z", 9.0), (1, "2401.00002", "Second", "2024-01-01", 0.0), (1, "2401.00001", "", None, 0.0), (1, "2401.00003", "Named one", None, 0.0),
    ]
    assert {r["paper"] for r in rows[4:]} == {"2401.00001", "2401.00003", "2401.00004"} and {r["page"] for r in rows} == {1}
    shown = media.trending_papers(pages, "id", "html", 1_706_659_200_000).collect()
    assert [(r["paper"], r["title"], r["heat_keep"], r["nth"]) for r in shown] == [("2401.00001", "A <b> title", False, 1)]


def test_an_old_paper_that_comes_back(spark):
    entry = lambda i, day, votes: {"paper": {"id": i, "upvotes": votes, "publishedAt": day, "title": f"t {i}"}}
    text = json.dumps({"dailyPapers": [entry("2312.00001", "2024-01-30", 150), entry("2312.00002", "2024-01-30", 99), entry("2311.00001", "2024-01-30", 900), entry("2401.00001", "2024-01-30", 4), entry("2401.00002", "2024-01-30", 0), entry("2401.00003", "no day", 900)]})
    pages = spark.createDataFrame([(1, f"<i data-target=\"DailyPapers\" data-props=\"{text.replace(chr(34), '&quot;')}\">")], "id int, html string")
    got = {r["paper"]: (r["published_raw"], r["heat_keep"]) for r in media.trending_papers(pages, "id", "html", 1_706_486_400_000).collect()}
    assert got == {"2312.00001": ("2023-12-31T23:59:59Z", True), "2401.00002": ("2024-01-30", False)}
