import random
from datetime import UTC, datetime, timedelta

import pytest
from dateutil import parser
from pyspark.sql import functions as F

from briefloom.functions import dates

NOW = 1_790_000_000_000
FORMS = (
    "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S+08:00", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S.%f", "%Y/%m/%d", "%Y.%m.%d %H:%M:%S", "%Y%m%d", "%Y%m%dT%H%M%S", "%Y%m%d%H%M",
    "%a, %d %b %Y %H:%M:%S GMT", "%a, %d %b %Y %H:%M:%S -0530", "%A, %B %d, %Y", "%B %d, %Y %I:%M %p", "%b %d %Y", "%b. %d, %Y", "%d %B %Y", "%d-%b-%Y", "%d-%b-%y", "%d %b %Y, %H:%M UTC",
    "%a %b %d %H:%M:%S %Y", "%a %b %d %H:%M:%S UTC %Y", "%Y %b %d", "%m/%d/%Y", "%m/%d/%y %H:%M", "%m-%d-%Y", "%B %d, %Y at %I:%M%p", "%b %d, %Y %I%p", "%dth of %B %Y", "%Y-%m-%d %H:%M:%S +02", "%d.%m.%Y",
)
OTHER = ("", "   ", "soon", "not a date", "2026-13-45", "2026-02-30", "31/31/2025", "2025-01-01 25:00", "2025-01-01T10:61", "2025-01-01 10:00:60", "2025-01-01 13:00 pm", "today is 2025-01-01", "2025-01-01 and more", "2025年4月8日")


def by_library(text):
    try:
        at = parser.parse(text)
    except (ValueError, OverflowError):
        return None
    ms = ((at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
    return ms if ms <= NOW + 2 * 86_400_000 else None


def test_forms_against_the_library(spark):
    rng = random.Random(5)
    start = datetime(1999, 1, 1, tzinfo=UTC)
    texts = [(start + timedelta(seconds=rng.randrange(27 * 365 * 86_400), milliseconds=rng.randrange(1000))).strftime(form) for form in FORMS for _ in range(20)]
    texts += [*OTHER, "January 2nd, 2025", "Tues, 3 March 2025", "2031-01-01", "1 Jan 2031 10:00 GMT"]
    got = {r["t"]: r["ms"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse_date_ms(F.col("t"), NOW).alias("ms")).collect()}
    wrong = {t: (got[t], by_library(t)) for t in texts if got[t] != by_library(t)}
    assert not wrong


def test_null_and_partial_dates_are_unknown(spark):
    rows = spark.createDataFrame([(None,), ("2025",), ("March 2025",), ("10:30",), ("5",)], "t string")
    assert [r["ms"] for r in rows.select(dates.parse_date_ms(F.col("t"), NOW).alias("ms")).collect()] == [None] * 5


PAGES = {
    '<meta property="article:published_time" content="2026-06-30T01:26:47Z"><meta property="article:modified_time" content="2026-07-27">': "2026-06-30T01:26:47Z",
    "<META content='2026-06-30' name='pubdate'>": "2026-06-30",
    r'push([1,"post\":{\"_createdAt\":\"2026-06-30T01:26:47Z\"}"])': "2026-06-30T01:26:47Z",
    '{"datePublished": "2026-06-30"}': "",
    '{"datePublished":"2026-06-30T00"}': "2026-06-30T00",
    "&quot;publishedAt&quot;:&quot;2026-06-30T00:00&quot;": "2026-06-30T00:00",
    '<time class="x" datetime="2026-06-30">June</time>': "2026-06-30",
    "<nav>Archive updated July 28, 2026</nav><h1 class=a>New</h1><div>April 8, 2026 • 8 minute read</div><p>Measured on March 1, 2026.</p>": "April 8, 2026",
    "<h1>New</h1><script>var x = 'May 1, 2026 | 3 min read'</script><p>April <b>8</b>, 2026 | 8 min read</p>": "",
    "<h1>New</h1>" + "x" * 5000 + "<p>April 8, 2026 • 8 minute read</p>": "",
    "<h1>Report</h1><p>The set was released on April 8, 2026.</p>": "",
    "<p>Published on 8 April 2026</p>": "8 April 2026",
    "<p>发布时间：<b>2026年4月8日</b></p>": "2026年4月8日",
    " " * 20_000 + "<p>Posted: 2026-04-08</p>": "",
    '<meta property="article:modified_time" content="2026-07-27T08:00:00Z">': "",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_published_in_html(spark, page):
    assert spark.range(1).select(dates.published_in_html(F.lit(page)).alias("x")).first()["x"] == PAGES[page]


def test_published_in_null(spark):
    assert spark.range(1).select(dates.published_in_html(F.lit(None).cast("string")).alias("x")).first()["x"] == ""
