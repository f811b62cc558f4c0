import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from briefloom.functions import markdown, pictures, url
from briefloom.operators.pictures import one_picture_each

PAGE = "https://example.com/blog/post/"


@pytest.fixture()
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_absolute_against_the_library(spark):
    rng = random.Random(2)
    bases = ["https://e.org", "https://e.org/", "http://e.org:80/a/b/c.html?x=1#f", "https://e.org/a/b/", "https://u@e.org/a//b/c", "https://e.org?q"]
    parts = ["", "/", "a", "b.png", "..", ".", "../", "./", "//", "?x=1", "#top", "c/", "图.png", "a b"]
    targets = ["", "//cdn.net/x/../y.png", "https://o.net/a/../b", "mailto:a@b.c", "data:image/png;base64,xx", "?", "#", "..", "/..", "/../../a", "a/./b", "x:y"]
    targets += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    # The library also reads "//" that follows steps as a host, and drops marks without a value: neither is a question of paths.
    targets = [t for t in targets if not t.startswith("//") or t.startswith("//cdn")]
    targets = [t for t in targets if not re.search(r"\?(#|$)|#$", t)]
    rows = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    wrong = [(r["b"], r["t"], r["x"], urljoin(r["b"], r["t"])) for r in rows.select("b", "t", url.absolute(F.col("b"), F.col("t")).alias("x")).collect() if r["x"] != urljoin(r["b"], r["t"])]
    assert not wrong, wrong[:10]


@pytest.mark.parametrize(
    ("html", "page", "want"),
    [
        ('<img src="/img/site-logo.png"><img src="/s.gif" width="1" height="1"><img src="/t.jpg" width="120" height="90"><img src="/d.jpg" width="1200" alt="A &amp; B">', PAGE, [("https://example.com/d.jpg", "A & B")]),
        ('<img src="https://s.w.org/72x72/1f5.png"><img src="/u/shot-150x150.png"><img src="/u/shot-1920x1080.png">', PAGE, [("https://example.com/u/shot-1920x1080.png", "")]),
        ('<img data-src="/a.jpg"><img srcset="/a.jpg 1x, /a@2x.jpg 2x"><IMG\nsrcset=" /b.jpg 800w">', PAGE, [("https://example.com/a.jpg", ""), ("https://example.com/b.jpg", "")]),
        ('<img src="hero.jpg" width="100%" height="auto"><img src="../chart.png" width="1200px"><img src="/i.png" width="32">', PAGE, [("https://example.com/blog/post/hero.jpg", ""), ("https://example.com/blog/chart.png", "")]),
        ('<img class="jmlr" src="/img/jmlr.jpg"><img src="/img/R.gif" class="rss" alt="RSS Feed"><img src="/img/figure-2.png">', "http://jmlr.org/papers/v27/25-1549.html", [("http://jmlr.org/img/figure-2.png", "")]),
        ('<img src="/brand.png" alt="logo" width="400"><img src="/adoption.png" alt="logo" width="800">', PAGE, [("https://example.com/adoption.png", "logo")]),
        ('<img src="data:image/png;base64,x"><img><img src=""><img src="//cdn.net/x.png?a=1&amp;b=2"><img src="//cdn.net/x.png?c"><img src="/v.SVG?x"><img src="ftp://e.org/x.png">', PAGE, [("https://cdn.net/x.png?a=1&b=2", "")]),
        ("".join(f'<img src="/{i}.png">' for i in range(9)), PAGE, [(f"https://example.com/{i}.png", "") for i in range(4)]),
        (f'<img src="/a.png" alt="{"x" * 200}">', PAGE, [("https://example.com/a.png", "x" * 120)]),
        ("", PAGE, []),
        (None, PAGE, []),
    ],
)
def test_pictures_of(value, html, page, want):
    assert [tuple(x) for x in value(pictures.pictures_of(F.lit(html).cast("string"), F.lit(page)))] == want


def test_script_cover(value):
    cover = lambda html: value(pictures.script_cover(F.lit(html), F.lit("https://mp.example.com/s/demo")))
    assert cover(r'<script>var msg_cdn_url = "https:\/\/c.example.cn\/cover.jpg";</script>') == "https://c.example.cn/cover.jpg"
    assert cover('cdn_url_1_1: "/b.jpg"') == "https://mp.example.com/b.jpg" and cover("msg_cdn_url='/avatar.png'") == "" and cover("") == ""


E = "https://e.org/"


@pytest.mark.parametrize(
    ("kind", "images", "thumbnail", "current", "cover", "want"),
    [
        ("文章", ["lucas.png", "rel.jpg"], None, "lucas.png", "jeff.jpg", (["jeff.jpg/article-cover"], "jeff.jpg")),
        ("公众号", ["wechat-qrcode.jpg"], None, None, None, ([], "")),
        ("纯网页", ["a.jpg", "b.jpg"], None, "author-photo.png", "newsletter.png", (["a.jpg/article-cover"], "a.jpg")),
        ("文章", ["a.jpg"], None, "own.jpg", None, (["own.jpg/article-cover"], "own.jpg")),
        ("视频", [], "max.jpg", "fallback.jpg", None, (["max.jpg/video-cover"], "max.jpg")),
        ("视频", ["a.jpg", "b.jpg"], "x.svg", "own.jpg", None, (["a.jpg/"], "own.jpg")),
        ("播客", ["a.jpg", "b.jpg"], None, None, None, (["a.jpg/podcast-cover"], "a.jpg")),
        ("播客", ["a.jpg", "b.jpg"], None, "logo.png", None, (["a.jpg/"], "")),
        ("论文", ["a.jpg", "avatar.jpg", "b.jpg"], None, " own.jpg ", "c.jpg", (["a.jpg/", "b.jpg/"], "own.jpg")),
        (None, None, None, None, None, ([], "")),
    ],
)
def test_display_media(value, kind, images, thumbnail, current, cover, want):
    link = lambda u: F.lit(None).cast("string") if u is None else F.lit(re.sub(r"\S+", lambda m: E + m[0], u))
    assets = F.lit(None).cast(pictures.ASSET) if images is None else F.array(*[F.struct(link(i).alias("url"), F.lit("").alias("alt"), F.lit("").alias("kind")) for i in images]).cast(pictures.ASSET)
    got = value(pictures.display_media(F.lit(kind).cast("string"), assets, link(thumbnail), link(current), link(cover), F.lit("T")))
    assert ([f"{i['url'].removeprefix(E)}/{i['kind']}" for i in got["images"]], got["image_url"].removeprefix(E)) == want


def test_filled_media(value):
    some = lambda *names: F.array(*[F.struct(F.lit(n).alias("url"), F.lit("").alias("alt")) for n in names]).cast(pictures.PICTURE)
    fill = lambda own, link, found: (lambda r: ([i["url"] for i in r["images"]], r["image_url"]))(value(pictures.filled_media(own, F.lit(link).cast("string"), found)))
    assert fill(some(), None, some("a", "b")) == (["a", "b"], "a") and fill(some("c"), "d", some("a")) == (["c"], "d")
    assert fill(some("c"), " ", some("a")) == (["c"], "a") and fill(F.lit(None).cast(pictures.PICTURE), "d", some()) == ([], "d")


def walk(rows):
    out = {}
    for grp in {r[0] for r in rows}:
        seen = set()
        for g, place, own, cover in sorted((r for r in rows if r[0] == grp), key=lambda r: r[1]):
            key = lambda u: (u or "").strip().split("?")[0].split("#")[0].lower()
            pick = next((u for u in (own, cover) if key(u) and key(u) not in seen), "")
            seen.add(key(pick))
            out[g, place] = pick
    return out


@pytest.mark.parametrize("names", [2, 12, 60])
def test_one_picture_each(spark, names):
    rng = random.Random(names)
    some = lambda: rng.choice([None, "", *(f"{E}{'A' if rng.random() < 0.5 else 'a'}{rng.randrange(names)}.png{rng.choice(['', '?x=1', '#t'])}" for _ in range(4))])
    rows = [(g, place, some(), some()) for g in ("x", "y", None) for place in rng.sample(range(1000), 60)]
    table = spark.createDataFrame(rows, "g string, place int, own string, cover string").withColumn("at", F.lit("kept"))
    got = one_picture_each(table, ["g"], "place", "own", "cover").collect()
    assert {(r["g"], r["place"]): r["image_url"] for r in got} == walk(rows) and {r["at"] for r in got} == {"kept"}


def test_chain_of_pictures_handed_on(spark):
    # Row 0 has only the second picture of row 1, which takes what row 2 asked for first, and so on.
    rows = [("g", 0, "https://e.org/0", None)] + [("g", i, f"https://e.org/{i - 1}", f"https://e.org/{i}") for i in range(1, 7)]
    table = spark.createDataFrame(rows, "g string, place int, own string, cover string")
    assert {(r["g"], r["place"]): r["image_url"] for r in one_picture_each(table, ["g"], "place", "own", "cover").collect()} == walk(rows)
    assert one_picture_each(table.limit(0), ["g"], "place", "own", "cover").count() == 0


BODY = "The model is designed to be our most capable one yet, with tools."


@pytest.mark.parametrize(
    ("text", "want", "images"),
    [
        (f"Title: x\n\nMarkdown Content:\n![Hero](https://c.net/hero-2880x1620.jpg)\n\n{BODY}\n", BODY, ["https://c.net/hero-2880x1620.jpg"]),
        (f"{BODY}\n\n## What [it does](https://e.org/x 'title') is new.\n\n---\n\n* * *\n\n### Three.  Words\there.\n", f"{BODY}\n\n# What it does is new.\n\n* * *\n\n# Three. Words here.", []),
        (f"# Head line\n\n{BODY}\n\n[![alt](/a.png)](/link) ![b](b.png?x=1) ![b](b.png?x=2) ![l](/logo.png)\n\n{BODY} Yes.", f"{BODY}\n\n{BODY} Yes.", ["https://e.org/a.png", "https://e.org/p/b.png?x=1"]),
        (f"{BODY} ![open](https://e.org/x", f"{BODY} ![open](https://e.org/x", []),
        ("", "", []),
        (None, "", []),
    ],
)
def test_article_of_markdown(value, text, want, images):
    got = value(markdown.article_of_markdown(F.lit(text).cast("string"), F.lit("https://e.org/p/q"), F.lit("Head line")))
    assert got["text"] == want and [i["url"] for i in got["images"]] == images


def test_long_text_that_never_closes(value):
    assert len(value(markdown.paragraphs(F.lit("![a](" + "x" * 200_000)))) == 200_005


def test_proxy_items(spark):
    columns = "id int, markdown string, url string, title string, published_raw string, community_block string"
    rows = [
        (1, f"Title: Paper page - Big model\n\nPublished Time: 2026-07-27T00:00:00Z\n\nMarkdown Content:\n{BODY}", "https://e.org/1", "listed", "", None),
        (2, f"Markdown Content:\n{BODY}", "https://e.org/2", "listed", "2026-01-01", "comments"),
        (3, f"Markdown Content:\n{BODY}", "https://e.org/3", None, None, None),
        (4, "", "https://e.org/4", "t", None, None),
        (5, None, "https://e.org/5", "t", None, None),
        (6, BODY, None, "t", None, None),
        (7, "Markdown Content:\n" + "word and " * 3000, "https://e.org/7", "t", None, "c" * 100),
    ]
    got = {r["id"]: r for r in markdown.proxy_items(spark.createDataFrame(rows, columns)).collect()}
    assert sorted(got) == [1, 2, 7] and "markdown" not in got[1]
    assert (got[1]["title"], got[1]["published_raw"], got[1]["body"]) == ("Big model", "2026-07-27T00:00:00Z", BODY)
    assert (got[2]["title"], got[2]["published_raw"], got[2]["body"]) == ("listed", "2026-01-01", f"{BODY}\n\ncomments")
    assert len(got[7]["body"]) == 15_000 and got[7]["body"].endswith("c" * 100)
