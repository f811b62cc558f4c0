import pytest
from pyspark.sql import functions as F

from briefloom.functions import cells, classify, dates, html, scoring, similarity, text, url

NOW = 1_706_659_200_000


@pytest.fixture()
def value(spark):
    """The value of a column expression on one row."""
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_urls(value):
    cases = {
        " HTTPS://E.org/A/?utm_source=x&y=2#top ": "https://e.org/a/?&y=2",
        "https://e.org/?ref=z": "https://e.org",
        "https://e.org/a///": "https://e.org/a",
        "": "",
    }
    for raw, want in cases.items():
        assert value(url.normalize_url(F.lit(raw))) == want
    assert value(url.normalize_url(F.lit(None).cast("string"))) == ""
    assert value(url.host(F.lit("https://www.E.org:80/a"))) == "e.org:80"
    assert value(url.arxiv_id(F.lit("https://arxiv.org/pdf/2401.01234v3"))) == "2401.01234"


def test_dedup_key_ladder(value):
    def key(link, method="RSS", strategy="", guid="", post="", title="T"):
        return value(url.dedup_key(*map(F.lit, (link, title, method, strategy, guid, post))))

    assert key("https://e.org", "Podcast", guid=" g1 ") == "podcast:g1"
    assert key("https://x.com/a/status/77", "Social") == "x:77"
    assert key("https://youtu.be/abcdefghijk", "Media") == "youtube:abcdefghijk"
    assert key("https://arxiv.org/abs/2401.01234", strategy="arxiv_id") == "arxiv:2401.01234"
    assert key("https://e.org/r", strategy="hash(model+v)", title="Big Model") == "release:big model"
    assert key("https://e.org/p", "Podcast") == "https://e.org/p"


def test_first_publication_is_the_earlier(value):
    assert value(url.first_published_ms(F.lit("2312.00001"), F.lit(NOW))) == 1_704_067_199_999
    assert value(url.first_published_ms(F.lit("2401.00001"), F.lit(1_705_000_000_000))) == 1_705_000_000_000
    assert value(url.first_published_ms(F.lit("2313.00001"), F.lit(5))) == 5
    assert value(url.first_published_ms(F.lit("2312.00001"), F.lit(None).cast("long"))) is None


def test_text(value):
    assert value(text.strip_html(F.lit("<b>a</b>　  b\n"))) == "a b"
    assert value(text.cjk_ratio(F.lit("模型ab"))) == 0.5 and value(text.cjk_ratio(F.lit(""))) == 0
    assert value(text.keyword_ok(F.lit("AI news"), F.lit(""), F.lit("ai"), F.lit(5))) is True
    assert value(text.keyword_ok(F.lit("x"), F.lit("ai ai"), F.lit("ai"), F.lit(3))) is False
    assert value(text.podcast_keyword_ok(F.lit("x"), F.lit("ai " * 2 + "z" * 1600 + "ai"), F.lit("ai"), F.lit(1))) is False
    assert value(text.bullet_title(F.lit("结论：内容，其余"), F.lit("要点 2"))) == "结论"
    assert value(html.pack_paragraphs(F.lit("aa\n\nbb\n\ncccc\nd\n\n\n\ne"), 6)) == ["aa\n\nbb", "cccc\nd", "e"]
    assert value(html.pack_paragraphs(F.lit(None).cast("string"), 5)) == [] and html.chunks_of("x" * 14 + "\n\ny", 6) == ["xxxxxx", "xxxxxx", "xx\n\ny"]
    long = "\n".join(f"## Part {i}\n" + "x" * 700 for i in range(3))
    assert value(text.structured_long_form(F.lit(long))) is True and value(text.structured_long_form(F.lit(long[:1500]))) is False
    assert value(text.headings_need_translation(F.lit("## 中文\n## Only Latin"))) is True


def test_dates(value):
    parse = lambda raw: value(dates.parse_date_ms(F.lit(raw), NOW))
    assert parse("Wed, 03 Jan 2024 10:00:00 GMT") == parse("2024-01-03T10:00:00+00:00") == parse("2024-01-03 10:00:00") == 1_704_276_000_000
    assert parse("2024-01-03T10:00:00+08:00") == 1_704_276_000_000 - 8 * 3_600_000
    assert parse("2024-02-05") is None and parse("soon") is None
    hours = lambda raw: value(dates.lookback_hours(F.lit(raw)))
    assert [hours(x) for x in ("36h", "1.5d", "每日", "每周", "", "0.5h")] == [36, 36, 24, 168, 168, 0]
    assert [value(dates.clock_seconds(F.lit(x))) for x in ("1:02:03", "12:05", "90", "bad")] == [3723, 725, 90, 0]
    assert [value(dates.iso_seconds(F.lit(x))) for x in ("PT1H2M3S", "PT12M5S", "x")] == [3723, 725, 0]
    assert value(dates.cn_day(F.lit(1_704_124_800_000 - 1))) == "2024-01-01" and value(dates.cn_day_start_ms(F.lit("2024-01-02"))) == 1_704_124_800_000
    assert value(dates.clock_label(F.lit(3723))) == "01:02:03"


def test_cells(value):
    assert value(cells.text_list(F.lit("A，b;; c"))) == ["a", "b", "c"]
    assert value(cells.truthy_number(F.lit(0), 168)) == 168
    assert value(cells.json_struct(F.lit("not json"), "k int")) is None and value(cells.json_struct(F.lit('{"k": 3}'), "k int"))["k"] == 3


def test_classification(value):
    assert value(classify.infer_topics(F.lit("OpenAI agent model"), F.lit("nvidia llm reasoning rag"))) == ["LLM", "Agent", "RAG", "推理", "AI"]
    fmt = lambda sid, end="", method="", entity=None, explicit=None: value(classify.signal_format(F.lit(sid), F.lit(end), F.lit(method), F.lit(entity).cast("string"), F.lit(explicit).cast("string")))
    assert fmt("a", explicit="Paper") == "论文" and fmt("a", entity="github") == "Github热榜"
    assert fmt("arxiv-cs") == "论文" and fmt("x", "https://youtu.be/1") == "视频" and fmt("my-podcast") == "播客" and fmt("plain") == "纯网页" and fmt("") == "其他"
    pinned = classify.normalize_topics(F.array(*map(F.lit, ("AI", "LLM", "Agent", "RAG", "其他"))), F.lit(True), F.lit(True))
    assert value(pinned) == ["AI", "LLM", "端侧", "监管"] and value(classify.normalize_topics(F.array(F.lit("?")), F.lit(False), F.lit(False))) == ["其他"]


def test_scores(value):
    assert value(scoring.quality(F.lit(100.0), F.lit(40.0), F.lit(60.0), F.lit(True))) == 71.0
    assert value(scoring.quality(F.lit(20.0), F.lit(0.0), F.lit(60.0), F.lit(False))) == 38.7
    venue = lambda name: tuple(value(scoring.venue_score(F.lit(name), F.array(F.lit("neurips")), F.array(F.lit("chil")))))
    assert venue("NeurIPS 2024") == (100.0, "whitelist") and venue("") == (20.0, "no_acceptance") and venue("CHIL") == (0.0, "blacklisted")
    assert value(scoring.accepted_venue(F.lit("Accepted at NeurIPS 2024 as a poster"), F.lit(""))) == "NeurIPS 2024"
    assert value(scoring.paper_signal(F.lit("A"), F.lit("short"), F.lit(""))) == 40
    assert [value(scoring.novelty_points(F.lit(x))) for x in (None, 0.1, 0.5, 0.7, 0.9)] == [20, 20, 12, 4, 0]
    assert value(scoring.prefer(F.lit(None).cast("string"), F.lit("P2"), F.lit("文章"), F.lit(5), F.lit(1)))["points"] == 20
    points = lambda tier, kind: value(scoring.prefer(F.lit(tier), F.lit("p0"), F.lit(kind), F.lit(5), F.lit(1)))["points"]
    assert [points("l1 官方", "Company Blog"), points("L1", "企业官方号"), points("L1", "Research"), points("x", "文章")] == [76, 76, 68, 42]
    assert value(text.valid_pattern(F.lit("[bad("))) is None and value(text.valid_pattern(F.lit("a|b"))) == "a|b"
    patterns = {r"(?P<x>ai)(?P=x)": r"(?<x>ai)\k<x>", r"\p{Lu}ai": r"\p{Lu}ai", "(?P<x": None, "(?P<a_b>c)": None, "": None, "*": None}
    assert {p: value(text.valid_pattern(F.lit(p))) for p in patterns} == patterns
    assert value(F.regexp_like(F.lit("AIai"), text.valid_pattern(F.lit(r"(?i)(?P<x>ai)(?P=x)"))))


def test_same_event_anchors(value):
    match = lambda a, b: value(similarity.entity_match(similarity.anchors(F.lit(a)), similarity.anchors(F.lit(b))))
    assert match("Introducing Acme Opus 5", "Acme Opus 5 来了")
    assert not match("Acme Opus 5", "Acme Sonnet 5") and not match("Summit 2026 opens in Geneva", "Summit 2026 closes in Geneva today")
    assert value(similarity.normalize_title(F.lit("重磅：Big News!"))) == "bignews"
    titles = lambda a, b: value(similarity.title_similarity(F.lit(a), F.lit(b)))
    assert titles("abc", "abc") == 1.0 and titles("", "a") == 0.0 and titles("a" * 16, "b" + "a" * 16) == 0.92


def test_html():
    page = "<script>x()</script><p>One &amp; two</p><table><tr><th>a</th><td>b</td></tr></table><h2>Head</h2><p>Three</p>"
    assert html.text_of_html(page) == "One & two\n\na | b\n\n## Head\n\nThree"
    assert html.article_of_html("<nav>menu</nav><article><p>" + "body " * 30 + "</p></article>").startswith("body")
    assert html.cut_on_boundary("aaaa. bbbb. cccc", 12) == "aaaa. bbbb." and html.cut_on_boundary("ab", 5) == "ab"
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nfirst\n\n01:00:05.000 --> 01:00:06.000\nsecond\nline"
    assert html.transcript_lines(vtt, "text/vtt") == [(1, "first"), (3605, "second line")]
    assert html.transcript_lines('{"segments": [{"startTime": 2000, "body": "x"}]}', "application/json") == [(2, "x")]
    assert html.transcript_lines("plain words", "text/plain") == [(0, "plain words")] and html.transcript_lines("", "") == []
