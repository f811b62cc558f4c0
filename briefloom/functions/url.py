"""URLs: canonical form, host and path, ids, dedup keys, links and images in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.similarity import bound
from briefloom.functions.text import filled

# Where ids and the parts of an address stand in URLs.
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|huggingface\.co/papers/)([0-9]{4}\.[0-9]{4,5})(?:v\d+)?"
YOUTUBE = r"(?i)(?:youtu\.be/|youtube\.com/(?:watch\?v=|shorts/|embed/))([\w-]{11})"
PARTS = r"(?s)^(?:([a-zA-Z][\w+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
POST = r"(?i)(?:x|twitter)\.com/[^/]+/status/(\d+)"


def normalize_url(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing marks, all in lower case; separators of parameters stay."""
    text = F.substring_index(F.trim(F.coalesce(url, F.lit(""))), "#", 1)
    text = F.regexp_replace(text, r"(?i)([?&])(utm_[^=&]*|ref)=[^&]*", "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[?&]+$", ""), "/+$", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def arxiv_id(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ARXIV, 1)


def arxiv_month_end_ms(paper: Column) -> Column:
    """The last moment of the month that an arXiv id names, null for other ids and impossible months."""
    year = F.try_to_number(F.nullif(F.regexp_extract(paper, r"^(\d{2})\d{2}\.", 1), F.lit("")), F.lit("99")).cast("int") + 2000
    month = F.try_to_number(F.nullif(F.regexp_extract(paper, r"^\d{2}(\d{2})\.", 1), F.lit("")), F.lit("99")).cast("int")
    good = month.between(1, 12)
    day = F.last_day(F.make_date(F.when(good, year), F.when(good, month), F.lit(1)))
    return F.unix_millis(F.to_timestamp(F.date_add(day, 1))) - 1


def first_published_ms(paper: Column, listed: Column) -> Column:
    """The earlier of the listed time and the end of the id's month; a missing listed time stays missing."""
    return F.when(listed.isNotNull(), F.least(listed, arxiv_month_end_ms(paper)))


def dedup_key(url: Column, title: Column, method: Column, strategy: Column, podcast_guid: Column, post_id: Column) -> Column:
    """The key ladder: podcast guid, post id, video id, arXiv id, release title, canonical URL; each step may fall through."""
    plan = F.coalesce(filled(strategy), F.lit("normalize(url)"))
    steps = [
        ((method == "Podcast") | plan.contains("podcast_guid"), F.left(F.concat(F.lit("podcast:"), filled(F.trim(podcast_guid))), F.lit(240))),
        ((method == "Social") | plan.contains("x_post_id"), F.concat(F.lit("x:"), F.coalesce(filled(post_id), filled(F.regexp_extract(url, POST, 1))))),
        ((method == "Media") | plan.contains("youtube_video_id"), F.concat(F.lit("youtube:"), filled(F.regexp_extract(url, YOUTUBE, 1)))),
        (plan.contains("arxiv_id"), F.concat(F.lit("arxiv:"), filled(arxiv_id(url)))),
        (plan.contains("hash(model"), F.left(F.concat(F.lit("release:"), F.lower(F.coalesce(filled(title), url))), F.lit(240))),
    ]
    return F.coalesce(*[F.when(when, key) for when, key in steps], url)


def path_allowed(where: Column, include: list[str], exclude: list[str]) -> Column:
    """No excluded pattern occurs in the path, and one of the included ones does if there are any."""
    lower, allowed = F.lower(where), F.lit(True)
    for pattern in exclude:
        allowed = allowed & ~lower.rlike(pattern)
    if include:
        allowed = allowed & lower.rlike("|".join(f"(?:{p})" for p in include))
    return allowed


def depth_ok(where: Column) -> Column:
    """Two path segments, or a digit in the path."""
    return (F.size(F.filter(F.split(where, "/"), lambda s: s != "")) >= 2) | where.rlike(r"\d")


def recency_key(where: Column) -> Column:
    """(latest year named in the path or 0, path)."""
    years = F.transform(F.regexp_extract_all(where, F.lit(r"(?:^|/)(20\d{2})(?=/|-|_)"), 1), lambda y: y.cast("int"))
    return F.struct(F.coalesce(F.array_max(years), F.lit(0)).alias("year"), where.alias("path"))


def hrefs(html: Column) -> Column:
    """Distinct link targets in document order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<a\b[^>]*?\bhref="([^"#]+)'), 1))


def absolute(page: Column, target: Column) -> Column:
    """``target`` as seen from ``page`` (RFC 3986): with a scheme as it stands, else from the scheme, the host, the path or the query.

    Steps up and steps on the spot are taken out of paths. A null target counts as empty, which is the page itself.
    """
    of_page = lambda i: F.regexp_extract(page, PARTS, i)
    origin = F.concat(of_page(1), F.lit(":"), of_page(2))

    def walked(full: Column) -> Column:
        steps = F.aggregate(
            F.split(F.regexp_replace(full, r"/(\.{1,2})$", "/$1/"), "/"),
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
        )
        return F.when(F.contains(full, F.lit("/.")), F.concat(F.lit("/"), F.regexp_replace(F.array_join(steps, "/"), "^/", ""))).otherwise(full)

    def resolved(t: Column) -> Column:
        target, where, rest = t["whole"], t["part3"], F.concat(t["part4"], t["part5"])
        beside = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(of_page(3), "^(.*/)", 1), where), "/{2,}", "/")
        full = F.when(F.startswith(where, F.lit("/")), where).otherwise(beside)
        return (
            F.when(t["part1"] != "", target)
            .when(target == "", page)
            .when(t["part2"] != "", F.concat(of_page(1), F.lit(":"), target))
            .when(where != "", F.concat(origin, bound(full, walked), rest))
            .when(t["part4"] != "", F.concat(origin, of_page(3), rest))
            .otherwise(F.concat(origin, of_page(3), of_page(4), rest))
        )

    parts = lambda whole: F.struct(whole.alias("whole"), *[F.regexp_extract(whole, PARTS, i).alias(f"part{i}") for i in range(1, 6)])
    return bound(bound(F.coalesce(target, F.lit("")), parts), resolved)


def image_key(url: Column) -> Column:
    """An image without its query and its size suffix."""
    return F.regexp_replace(F.substring_index(F.lower(url), "?", 1), r"-\d{2,4}x\d{2,4}(?=\.\w+$)", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def endpoint(address: Column) -> Column:
    """An address with a scheme, and with all but the characters of URLs percent-encoded."""
    text = F.trim(F.coalesce(address, F.lit("")))
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    out = F.replace(F.url_encode(full), F.lit("+"), F.lit("%20"))
    for code, mark in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%23", "#"), ("%7E", "~"), ("%25", "%")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.when(text == "", "").otherwise(F.replace(out, F.lit("*"), F.lit("%2A")))


def detail_url(base: Column, day: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/?date="), F.url_encode(day))


def pdf_url(url: Column, paper: Column) -> Column:
    """The PDF of an arXiv id or page, or the URL itself where it names a PDF; else empty."""
    found = F.coalesce(filled(paper), filled(arxiv_id(url)))
    return F.when(found.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), found)).when(F.lower(url).rlike(r"\.pdf(?:$|\?)"), url).otherwise("")
