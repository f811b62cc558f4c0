"""Text: tags, white space, keyword density, CJK share, structure, cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions.similarity import bound

CJK = "[一-鿿]"
# Entities that stand for one character, the ampersand's last.
ENTITIES = {"&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&#38;": "&", "&amp;": "&"}


#: All characters of white space, as ``(?U)\\s`` has them.
WHITE = "\t\n\x0b\f\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"



def once(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with columns that are computed once, however often later steps use them; others of these names go.

    A generator of one row stands between the steps, as the optimizer puts the expressions of a projection where they are used.
    """
    made = F.inline(F.array(F.struct(*[value.alias(name) for name, value in values.items()])))
    return rows.select(*[c for c in rows.columns if c not in values], made)


def blank(value: Column) -> Column:
    """Null and the empty text alike count as missing."""
    return F.coalesce(value, F.lit("")) == ""


def filled(value: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(value, F.lit(""))


def where_held(text: Column, mark: str, *steps: tuple[str, str]) -> Column:
    """The text after the replacements ``steps`` (pattern, by what), which are left out where it does not hold ``mark``."""
    after = lambda t: reduce(lambda out, step: F.regexp_replace(out, *step), steps, t)
    return bound(text, lambda t: F.when(F.contains(t, F.lit(mark)), after(t)).otherwise(t))


def single_blanks(text: Column) -> Column:
    """Runs of blanks and tabs become one blank."""
    return where_held(F.replace(text, F.lit("\t"), F.lit(" ")), "  ", ("  +", " "))


def bare_line_ends(text: Column) -> Column:
    """Blanks at the ends and starts of lines go."""
    beside = lambda t: F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\n "))
    return bound(text, lambda t: F.when(beside(t), F.regexp_replace(t, " +\n *|\n +", "\n")).otherwise(t))


def unescaped(text: Column) -> Column:
    """The text with the listed entities as characters; others stay as they are, and null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for entity, mark in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return out


def strip_html(text: Column) -> Column:
    """Tags go without a trace, and white space of any kind becomes one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", ""), r"(?U)\s+", " "))


def plain_text(text: Column) -> Column:
    """Tags become blanks, and white space becomes one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), r"(?U)\s+", " "))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def hits(text: Column, pattern: Column) -> Column:
    """How often a pattern occurs, without regard to case."""
    return F.coalesce(F.regexp_count(F.coalesce(text, F.lit("")), F.concat(F.lit("(?i)"), pattern)), F.lit(0))


def keyword_ok(title: Column, body: Column, pattern: Column, least: Column) -> Column:
    """A hit in the title is enough; else the body needs ``least`` hits, and one at least."""
    return (hits(title, pattern) > 0) | (hits(body, pattern) >= F.greatest(least, F.lit(1)))


def podcast_keyword_ok(title: Column, body: Column, pattern: Column, least: Column) -> Column:
    """For podcasts only the first 1600 characters count, and three hits are the least."""
    return (hits(title, pattern) > 0) | (hits(F.substring(body, 1, 1600), pattern) >= F.greatest(least, F.lit(3)))


def cjk_ratio(text: Column) -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) == 0, F.lit(0.0)).otherwise(F.regexp_count(body, F.lit(CJK)) / F.length(body))


def is_chinese(text: Column) -> Column:
    return cjk_ratio(text) >= 0.15


def headings(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^##\s+([^\n]{2,80})\s*$"), 1), lambda h: F.trim(h))


def headings_need_translation(text: Column) -> Column:
    return F.exists(headings(text), lambda h: ~h.rlike(CJK))


def structured_long_form(text: Column) -> Column:
    """At least 1800 characters, three different headings and three sections of 180 characters."""
    # Headings that introduce link lists and not sections.
    noise = "^(?:相关文章|推荐阅读|热门|标签|关于作者|联系我们|相关阅读|更多内容)$"
    named = F.array_distinct(F.filter(headings(text), lambda h: ~h.rlike(noise)))
    sections = F.slice(F.split(F.coalesce(text, F.lit("")), r"(?m)^##\s+[^\n]+\s*$"), 2, 100_000)
    long = F.filter(sections, lambda s: F.length(F.trim(s)) >= 180)
    return (F.length(text) >= 1800) & (F.size(named) >= 3) & (F.size(long) >= 3)


def bullet_title(text: Column, suggested: Column) -> Column:
    """The suggested title unless it is a placeholder; else the text up to its first separator, at most 28 characters."""
    given = F.trim(F.coalesce(suggested, F.lit("")))
    short = text
    for mark in reversed(("：", ":", "，", "。", "；", ";")):
        short = F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, 1)).otherwise(short)
    return F.when((given != "") & ~given.rlike(r"^要点\s*\d*$"), given).otherwise(F.substring(F.trim(short), 1, 28))


def cut_promotion(body: Column, pattern: str) -> Column:
    """Cuts a promotional tail, where it begins behind three fifths of the text."""
    at = F.regexp_instr(body, F.lit(pattern))
    return F.when(at - 1 >= F.length(body) * 0.6, F.rtrim(F.substr(body, F.lit(1), at - 1))).otherwise(body)


def valid_pattern(pattern: Column) -> Column:
    """A pattern of a configuration row as the engine runs it; null where it is no regular expression, so that the default holds.

    The engine's own compiler decides. Groups that are named in the form ``(?P<name>`` are rewritten to its form first.
    """
    own = F.regexp_replace(F.regexp_replace(pattern, r"\(\?P<", "(?<"), r"\(\?P=(\w+)\)", r"\\k<$1>")
    return F.when(own != "", F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), own))
