"""Dates, durations and time zones; times are epoch milliseconds, and days are those of UTC+8."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.config import DAY_MS
from briefloom.functions.similarity import bound
from briefloom.functions.text import filled, plain_text, unescaped

# Months, weekdays and zones as dates write them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)[.,]?\s+)?"
_DAY, _TAIL = r"(\d{1,2})(?:st|nd|rd|th)?", r"(?:(?:\s+at\s+|[t,\s]\s*)(\S.*))?$"
_CLOCK = r"(\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,9})?)"

#: What a date may look like: the pattern of its day, and which groups are year, month, day and what follows.
DAY_FORMS = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL, (1, 2, 3, 4)),
    (r"(\d{4})(\d{2})(\d{2})(?:t?(\d.*))?$", (1, 2, 3, 4)),
    (_DAY + r"(?:\s+of\s+|[\s-]+)" + _MONTH + r"[\s,-]+(\d{4}|\d{2})" + _TAIL, (3, 2, 1, 4)),
    (_MONTH + r"[\s-]+" + _DAY + r"(?:,\s*|[\s-]+)(\d{4})" + _TAIL, (3, 1, 2, 4)),
    (_MONTH + r"\s+" + _DAY + r"\s+" + _CLOCK + r"\s+(?:utc\s+|gmt\s+)?(\d{4})$", (4, 1, 2, 3)),
    (r"(\d{4})[\s-]+" + _MONTH + r"[\s-]+" + _DAY + _TAIL, (1, 2, 3, 4)),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TAIL, (3, 1, 2, 4)),
)
_ZONE = r"\s*(z|utc|gmt|[+-]\d{1,2}(?::?\d{2})?)?"
TIME = r"^(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]m?)?" + _ZONE + "$"
HOUR = r"^(\d{1,2})\s*([ap]m)" + _ZONE + "$"


def date_parts(raw: Column) -> Column:
    """(``year``, ``month``, ``day``, ``rest``) of a text that begins with a day in a known form, all as text; null for others.

    Months are names or numbers. Where all three are numbers and the year is last, the month is first unless it is over 12.
    """

    def read(text: Column) -> Column:
        found = []
        for pattern, groups in DAY_FORMS:
            whole = rf"^{_WEEKDAY}{pattern}"
            year, month, day, rest = (F.regexp_extract(text, whole, i) for i in groups)
            swapped = month.try_cast("int") > 12
            turned = groups[0] == 3 and "[-/.]" in pattern
            names = (F.when(swapped, day).otherwise(month), F.when(swapped, month).otherwise(day)) if turned else (month, day)
            found.append(F.when(text.rlike(whole), F.struct(year.alias("year"), names[0].alias("month"), names[1].alias("day"), rest.alias("rest"))))
        return F.coalesce(*found)

    return bound(F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "))), read)


def parse_date_ms(raw: Column, now_ms: int) -> Column:
    """Milliseconds of a date in any of the known forms, with a time and zone or without; null for other texts.

    A time without zone is UTC; a year of two digits is the one within fifty years of now. Days that do not exist, partial
    dates, texts with further words and times over two days ahead are null.
    """
    # A cast that fails costs far more than a look at the text.
    number = lambda c: F.when(c.rlike(r"^\d{1,9}$"), c.try_cast("int"))

    def told(p: Column) -> Column:
        rest = p["rest"]
        clock = [F.regexp_extract(rest, TIME, i).alias(f"clock{i}") for i in range(1, 7)]
        hour = [F.regexp_extract(rest, HOUR, i).alias(f"hour{i}") for i in range(1, 4)]
        return F.when(p.isNotNull(), F.struct(p.alias("day"), rest.rlike(TIME).alias("timed"), rest.rlike(HOUR).alias("by_hour"), *clock, *hour))

    def moment(t: Column) -> Column:
        p, timed, by_hour, clock = t["day"], t["timed"], t["by_hour"], lambda i: t[f"clock{i}"]
        century = F.lit(now_ms / (365.2425 * DAY_MS) + 1970).cast("int")
        short = century - century % 100 + number(p["year"])
        near = F.when(short >= century + 50, short - 100).when(short < century - 50, short + 100).otherwise(short)
        year = F.when(F.length(p["year"]) == 2, near).otherwise(number(p["year"]))
        month = F.coalesce(number(p["month"]), F.array_position(F.array(*map(F.lit, MONTHS)), F.left(p["month"], F.lit(3))).cast("int"))
        half = F.left(F.when(by_hour, t["hour2"]).otherwise(clock(5)), F.lit(1))
        hour = F.when(by_hour, number(t["hour1"])).otherwise(number(clock(1)))
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        zone = F.when(by_hour, t["hour3"]).otherwise(clock(6))
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        digits = F.regexp_replace(zone, r"\D", "")
        off = lambda i: F.coalesce(number(F.regexp_extract(digits, r"^(\d{1,2}?)(\d{2})?$", i)), F.lit(0))
        bare = p["rest"] == ""
        at = F.try_make_timestamp(
            year, month, number(p["day"]),
            F.when(bare, 0).otherwise(hour), F.when(bare | by_hour, 0).otherwise(number(clock(2))), F.when(bare | by_hour, 0).otherwise(F.coalesce(number(clock(3)), F.lit(0))).cast("decimal(8,6)"),
            F.lit("UTC"),
        )
        part = F.coalesce(number(F.left(F.rpad(clock(4), 3, "0"), F.lit(3))), F.lit(0))
        real = F.coalesce(number(clock(3)), F.lit(0)) < 60
        return F.when((bare | by_hour | timed) & real, F.unix_millis(at) + F.when(bare | by_hour, 0).otherwise(part) - sign * (off(1) * 60 + off(2)) * 60_000)

    ms = bound(bound(date_parts(raw), told), moment)
    return bound(ms, lambda ms: F.when(ms <= now_ms + 2 * DAY_MS, ms))


# Names of the date of first publication; a date beside the time that reading takes; dates behind a word that says so.
PUBLISHED_KEYS = ("article:published_time", "datePublished", "date_published", "publishedAt", "publishDate", "pubdate", "_createdAt")
HEADER_DATE = r"(?iU)([A-Z][a-z]{2,8}\s+\d{1,2},\s+20\d{2})\s*[•·|]\s*\d+\s*(?:minute|min)\s+read\b"
LABELLED_DATE = (
    r"(?iU)(?:published|posted|发布日期|发布时间)\s*(?:on|[:：])?\s*"
    r"([A-Z][a-z]{2,8}\s+\d{1,2},\s+20\d{2}|"
    r"\d{1,2}\s+[A-Z][a-z]{2,8}\s+20\d{2}|"
    r"20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)"
)
# How far behind the title its header reaches, and how far from the page's start a labelled date may be.
HEADER_CHARS, LABEL_CHARS = 5000, 20_000


def published_in_html(page: Column) -> Column:
    """The first date that a page states for its publication, as written: in its meta tags, whichever attribute is first, in JSON
    (escaped, too), in a time tag, in the header behind its title beside the time that reading takes, behind a word that says so.

    Dates of changes do not count, nor do dates in the text. Null and empty pages give the empty text.
    """
    shown = lambda c: plain_text(F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1>|\z)", " "))
    keys = "|".join(PUBLISHED_KEYS)

    def stated(html: Column) -> Column:
        small = F.lower(html)
        # The names are searched as plain texts first, which most pages do not hold.
        named = F.when(reduce(or_, [F.contains(small, F.lit(key.lower())) for key in PUBLISHED_KEYS]), html).otherwise("")
        timed = F.when(F.contains(small, F.lit("<time")), html).otherwise("")
        header = F.when(small.rlike(r"\bread\b"), F.regexp_extract(html, rf"(?is)(<h1\b[^>]*>.*?</h1\s*>.{{0,{HEADER_CHARS}}})", 1)).otherwise("")
        steps = [
            (named, rf"""(?is)<meta\b[^>]*(?:property|name)=["'](?:{keys})["'][^>]*content=["']([^"']+)["']"""),
            (named, rf"""(?is)<meta\b[^>]*content=["']([^"']+)["'][^>]*(?:property|name)=["'](?:{keys})["']"""),
            (named, rf"""(?i)(?:{keys})\\?["']?\s*:\\?["']([^"'\\<]{{8,80}})"""),
            (timed, r"""(?is)<time\b[^>]*datetime=["']([^"']+)["'][^>]*>"""),
            (shown(header), HEADER_DATE),
            (shown(F.left(html, F.lit(LABEL_CHARS))), LABELLED_DATE),
        ]
        return F.coalesce(*[filled(F.trim(F.regexp_extract(text, pattern, 1))) for text, pattern in steps], F.lit(""))

    return bound(unescaped(page), stated)


def epoch_to_ms(value: Column) -> Column:
    """Numbers over 1e10 are milliseconds, smaller ones seconds."""
    return F.when(value > 10_000_000_000, value).otherwise(value * 1000).cast("long")


def lookback_hours(raw: Column) -> Column:
    """Hours from texts such as 24h, 7d, 每日 or 每周; 168 without a known one."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    hours = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*h", 1)
    days = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*d", 1)
    return (
        F.when(hours != "", F.floor(hours.try_cast("double")))
        .when(days != "", F.floor(days.try_cast("double") * 24))
        .when(text.contains("每日"), 24)
        .otherwise(168)
        .cast("int")
    )


def clock_seconds(raw: Column) -> Column:
    """Seconds from h:m:s, m:s or s; 0 for other texts."""
    parts = F.split(F.trim(raw), ":")
    values = F.transform(parts, lambda p: p.try_cast("int"))
    total = F.aggregate(values, F.lit(0), lambda a, v: a * 60 + v)
    return F.when(F.trim(raw).rlike(r"^\d{1,7}(?::\d{1,2}){0,2}$"), total).otherwise(0)


def iso_seconds(raw: Column) -> Column:
    """Seconds from PT1H2M3S; 0 for other texts."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda i: F.coalesce(F.regexp_extract(raw, pattern, i).try_cast("int"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def clock_label(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", pad(F.floor(whole / 3600)), pad(F.floor(whole / 60) % 60), pad(whole % 60))


def cn_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms + 8 * 3_600_000), "yyyy-MM-dd")


def cn_day_start_ms(day: Column) -> Column:
    return F.unix_millis(F.to_timestamp(day, "yyyy-MM-dd")) - 8 * 3_600_000


def age_days(ms: Column, now_ms: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now_ms) - ms) / DAY_MS)
