"""Bodies of articles as arrays of paragraphs: what leads in, labels, cards, footers, bylines, covers, budgets."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.functions import html, url
from briefloom.functions.similarity import bound
from briefloom.functions.text import WHITE, bare_line_ends, blank, cjk_ratio, single_blanks, where_held

# Months, dates on a line of their own, and what stands before, between and behind the paragraphs of pages.
MONTHS = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
    r"aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
DATE_LINE = (
    r"(?i)^(?:published\s+)?(?:on\s+)?(?:"
    r"\d{4}\s*[-/年.]\s*\d{1,2}\s*[-/月.]\s*\d{1,2}\s*日?"
    rf"|(?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}"
    rf"|\d{{1,2}}\s+(?:{MONTHS})\.?,?\s+\d{{4}}"
    r")\s*$"
)
LEAD_LINE = (
    r"(?i)^(?:"
    r"(?:skip|jump)\s+to\b.{0,40}"
    r"|(?:by|作者|编辑|编译|撰文|责编|来源)\s*[:：|｜]?\s*.{0,30}"
    r"|\d+\s*(?:min(?:ute)?s?|分钟)\s*(?:read|阅读).{0,20}"
    r"|share(?:\s+this)?.{0,20}"
    r"|(?:read|learn)\s+more.{0,20}"
    r"|(?:subscribe|sign\s*(?:in|up)|log\s*in)\b.{0,40}"
    r"|(?:menu|home|blog|news(?:room)?|research|products?|company|about|careers?|contact|"
    r"privacy|terms|docs|pricing|download|support|overview|announcements?)"
    r"|published|updated?\s+on\s+\w+|upvotes?\s*\d*|\+\d+"
    r"|\d+\s*(?:likes?|comments?|shares?|views?|min)"
    r"|.{0,60}\bfollow(?:ing)?"
    r")\s*$"
)
LABEL_LINE = (
    r"(?i)^(?:"
    r"read\s+more|see\s+more|learn\s+more|more\s+from\b.*|related\b.*|share\s+this\b.*"
    r"|follow\s+us\b.*|subscribe\b.*|sign\s*up\b.*|newsletter\b.*|copyright\b.*|©.*"
    r"|阅读更多|查看更多|了解更多|相关阅读|相关文章|推荐阅读|关注我们|订阅.*|版权所有.*"
    r")\s*$"
)
CARD_BUTTON = r"(?i)^(?:read|see|learn)\s+more|^(?:阅读更多|查看更多|了解更多)$"
RIGHTS_LINE = r"(?i)(©|\ball rights reserved\b|版权所有)"
SENTENCE_END = r"[.。!！?？;；]"
BYLINE = r"(?U)(?:作者|编译|编辑|撰文|责编|来源|文)\s*[|｜/:：]\s*\S{1,20}\s*"
FEED_TAIL = r"(?is)\n*The post\b.*?\bappeared first on\b[^\n]*$"
COVER_NOISE = (
    r"(?i)(?:"
    r"author[-_/ ]?(?:avatar|photo|bio)|byline|contributor|profile[-_/ ]?(?:image|photo)"
    r"|avatar|headshot|gravatar|newsletter|subscribe|advertis(?:e|ement)|sponsor"
    r"|qrcode|qr[-_ ]?code|wechat|weixin|公众号|二维码|扫码|赞赏|打赏|联系(?:我们|作者)"
    r")"
)
COVER_NAMES = ("og:image", "og:image:url", "twitter:image", "twitter:image:src")
EDGE_TOPIC = (
    r"(?i)(?:端侧|端上|设备端|端云|"
    r"(?:手机|移动|车载|设备)端(?:模型|AI|智能|推理|部署|运行)|"
    r"边缘(?:AI|人工智能|模型|推理|计算|设备|平台)|"
    r"(?:模型|AI|智能体).{0,10}(?:手机|移动设备)|"
    r"(?:手机|移动设备).{0,10}(?:模型|AI|智能体|推理)|"
    r"on[- ]device|device[- ]side|"
    r"edge[- ](?:ai|inference|computing|device)|"
    r"(?:手机|移动|车载|端侧).{0,12}\bNPU\b|\bNPU\b.{0,12}(?:手机|移动|车载|端侧))"
)
POLICY_PREFIX = "whitehouse-tech-"
LEAD_CHARS, LABEL_CHARS, FOOTER_CHARS, RIGHTS_CHARS, BAR_CHARS, BYLINE_HEAD = 45, 40, 30, 60, 80, 120
OLD_TRANSLATION_CHARS = 3000

# What the standard library takes for an entity; white space of clean bodies beside line ends.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
BLANKS = "\t\u00a0\u3000"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _characters_of(entities: pd.Series) -> pd.Series:
    return entities.map(lambda found: [unescape(entity) for entity in found])


def unescape_text(text: Column) -> Column:
    """The text with its entities as characters; only they go through Python, and null becomes empty."""
    whole = F.coalesce(text, F.lit(""))
    marks = _characters_of(F.regexp_extract_all(whole, F.lit(ENTITY), 0))
    joined = F.zip_with(F.split(whole, ENTITY), marks, lambda part, mark: F.concat(part, F.coalesce(mark, F.lit(""))))
    return F.when(F.contains(whole, F.lit("&")), F.array_join(joined, "")).otherwise(whole)


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def _letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\W+", ""))


def _leads_in(x: Column, title: Column) -> Column:
    """An empty paragraph, an echo of the title, a date, a byline or button, or a short piece without a sentence's end."""
    line, letters = x["line"], x["letters"]
    echo = F.contains(title, letters) | (F.contains(letters, title) & (F.length(letters) <= F.length(title) * 1.6))
    fragment = (F.length(line) < LEAD_CHARS) & ~line.rlike(SENTENCE_END)
    return (line == "") | fragment | ((title != "") & echo) | line.rlike(DATE_LINE) | line.rlike(LEAD_LINE)


def _without_dates(parts: Column) -> Column:
    """Paragraphs without lone dates among the first three."""
    return F.concat(F.filter(F.slice(parts, 1, 3), lambda p: ~stripped(p).rlike(DATE_LINE)), F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))))


def drop_leading(text: Column, title: Column) -> Column:
    """The body from its first real paragraph on, without lone dates in the three that follow; whole if nothing is left.

    Null text gives the empty text; a null title is no title.
    """
    whole = F.coalesce(text, F.lit(""))

    def from_first(parts: Column, letters: Column) -> Column:
        read = lambda p: F.struct(stripped(p).alias("line"), _letters(p).alias("letters"))
        leads = lambda p: bound(read(p), lambda x: _leads_in(x, letters))
        # Down by one with each paragraph that leads in, then the place of the first that does not; no other is tested.
        start = F.aggregate(parts, F.lit(0), lambda at, p: F.when(at > 0, at).when(leads(p), at - 1).otherwise(1 - at))
        return bound(start, lambda at: F.when(at > 0, _without_dates(F.slice(parts, F.greatest(at, F.lit(1)).cast("int"), F.size(parts)))))

    kept = bound(F.split(whole, "\n\n"), lambda parts: bound(_letters(title), lambda letters: from_first(parts, letters)))
    return bound(stripped(F.array_join(kept, "\n\n")), lambda text: F.when(blank(text), stripped(whole)).otherwise(text))


def _before_cards(parts: Column) -> Column:
    """Two buttons such as "read more" in the second half show a grid of cards: it goes, first card included."""

    def cut(buttons: Column) -> Column:
        first, second = F.get(buttons, F.lit(0)), F.get(buttons, F.lit(1))
        end = F.greatest(first - F.greatest(second - first - 1, F.lit(0)), F.lit(0))
        return F.when(second.isNotNull() & (first >= F.size(parts) * 0.5), F.slice(parts, F.lit(1), end)).otherwise(parts)

    places = F.transform(parts, lambda p, i: F.when(p.rlike(CARD_BUTTON), i))
    return bound(F.filter(places, lambda i: i.isNotNull()), cut)


def _is_footer(line: Column) -> Column:
    """A line of rights, a bare label, or a row of capitalised words without any mark, as navigation bars give."""
    capital = lambda words: F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    open_end = ~line.rlike(SENTENCE_END)
    named = bound(F.split(line, r"(?U)\s+"), lambda words: (F.size(words) >= 3) & (capital(words) >= F.size(words) * 0.7))
    # Long lines are none of them: their lengths are tested before their characters.
    bar = (F.length(line) <= BAR_CHARS) & open_end & ~line.rlike("[,，]") & named
    return ((F.length(line) < RIGHTS_CHARS) & line.rlike(RIGHTS_LINE)) | ((F.length(line) <= FOOTER_CHARS) & open_end) | bar


def drop_labels(text: Column) -> Column:
    """The body without cards of other articles, label paragraphs, paragraphs that repeat the one before, and footers."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), stripped), lambda p: p != "")
    label = lambda p: p.rlike(LABEL_LINE) & ((F.length(p) < LABEL_CHARS) | ~p.rlike(SENTENCE_END))
    plain = F.filter(bound(parts, _before_cards), lambda p: ~label(p))
    once = bound(plain, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.get(ps, i - 1))))

    def to_last(ps: Column) -> Column:
        # From the end, down by one with each footer, then the place of the first that is none; no other is tested.
        last = F.aggregate(F.reverse(ps), F.lit(0), lambda at, p: F.when(at > 0, at).when(_is_footer(p), at - 1).otherwise(F.size(ps) + at))
        return F.slice(ps, F.lit(1), F.greatest(last, F.lit(0)))

    return F.array_join(bound(once, to_last), "\n\n")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)(?<![\w:-]){name}\s*=\s*(["'])(.*?)\1""", 2)


def meta_cover(page: Column, page_url: Column) -> Column:
    """The first cover that the page's meta tags name, as an absolute address; empty if none of them is a picture of it."""
    tags = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?i)<meta\b[^>]*>"), 0)
    named = F.filter(tags, lambda t: F.lower(F.coalesce(F.nullif(_attribute(t, "property"), F.lit("")), _attribute(t, "name"))).isin(*COVER_NAMES))
    found = F.transform(named, lambda t: F.trim(F.replace(_attribute(t, "content"), F.lit("&amp;"), F.lit("&"))))
    full = F.transform(F.filter(found, lambda u: u != ""), lambda u: url.absolute(page_url, u))
    picture = lambda u: u.rlike("(?i)^https?://") & ~u.rlike(r"(?i)logo|icon|pixel|sprite|1x1|\.svg(?:$|\?)") & ~u.rlike(COVER_NOISE)
    return F.coalesce(F.get(F.filter(full, picture), F.lit(0)), F.lit(""))


def clean_body(text: Column, source: Column) -> Column:
    """Entities decoded, a Chinese byline before the first sentence's end gone, white space squeezed, a feed's tail cut."""

    def without_byline(body: Column) -> Column:
        stop = F.regexp_instr(F.substring(body, 1, BYLINE_HEAD), F.lit("[。！？]"))
        cut = F.when(stop > 0, stop - 1).otherwise(F.least(F.length(body), F.lit(BYLINE_HEAD)))
        head, tail = F.substr(body, F.lit(1), cut), F.substr(body, cut + 1)
        bare = F.regexp_replace(F.regexp_replace(head, BYLINE, ""), r"(?U)^\s+", "")
        name = F.trim(F.coalesce(source, F.lit("")))
        bare = F.when((name != "") & F.startswith(bare, name), F.substr(bare, F.length(name) + 1)).otherwise(bare)
        return F.concat(F.regexp_replace(F.when(cjk_ratio(head) >= 0.3, bare).otherwise(head), r"(?U)^\s+", ""), tail)

    out = bound(stripped(unescape_text(text)), without_byline)
    out = stripped(bare_line_ends(stripped(single_blanks(F.translate(out, BLANKS, " " * len(BLANKS))))))
    out = stripped(where_held(out, "\n\n\n", ("\n{3,}", "\n\n")))
    return bound(out, lambda t: F.when(F.contains(F.lower(t), F.lit("the post")), stripped(F.regexp_replace(t, FEED_TAIL, ""))).otherwise(t))


def display_body(body: Column, translated: Column, covered: Column) -> Column:
    """(body, truncated): the translation if there is one, and whether the original goes on behind what it covers."""
    reach = F.coalesce(F.nullif(covered.cast("int"), F.lit(0)), F.lit(OLD_TRANSLATION_CHARS))
    has = ~blank(translated)
    shown = F.when(has, translated).otherwise(F.coalesce(body, F.lit("")))
    return F.struct(shown.alias("body"), (has & (F.length(F.coalesce(body, F.lit(""))) > reach)).alias("truncated"))


def _sections_within(text: str, most: int) -> str:
    _, *parts = re.split(r"(?m)^##\s+([^\n]{2,80})\s*$", text)
    heads, bodies = parts[0::2], parts[1::2]
    if len(heads) < 3 or len(text) <= most:
        return text
    share = max(120, (most - sum(len(h) + 5 for h in heads[:6])) // len(heads[:6]))
    short = [(h.strip(), html.cut_on_boundary(b.strip(), share)) for h, b in zip(heads[:6], bodies, strict=False)]
    return "\n\n".join(f"## {h}\n{b}" for h, b in short if b)[:most].rstrip()


def compact_sections(text: Column, most: int = 1400, source: Column | None = None) -> Column:
    """A body, cleaned first, of three or more sections within ``most`` characters: the first six, each cut to an equal share.

    ``source`` is the name that a byline may begin with.
    """

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _sections_within(t or "", most))

    return run(clean_body(text, F.lit("") if source is None else source))


def join_hyphens(text: Column, over_blanks: bool = False) -> Column:
    """Words that a line's end divides are joined; blanks at line ends and runs of empty lines go.

    ``over_blanks`` also joins over blanks around the line's end, and then keeps runs of blanks within lines.
    """
    gap = r"\s*\n\s*" if over_blanks else "\n"
    # The hyphen comes first: what is before it is only looked at where one stands.
    out = where_held(F.coalesce(text, F.lit("")), "-", (rf"(?U)-(?<=\w-){gap}(?=\w)", ""))
    out = where_held(out, "\n", ("[ \t]+\n", "\n")) if over_blanks else bare_line_ends(single_blanks(out))
    return stripped(where_held(out, "\n\n\n", ("\n{3,}", "\n\n")))


def is_edge_topic(title: Column, title_cn: Column, summary: Column) -> Column:
    """Whether title and summary speak of models on devices; the body does not count."""
    return F.substring(F.concat_ws("\n", title, title_cn, summary), 1, 12_000).rlike(EDGE_TOPIC)


def is_policy_source(source_id: Column) -> Column:
    return F.startswith(F.lower(F.coalesce(source_id, F.lit(""))), F.lit(POLICY_PREFIX))


def is_policy_document(source_id: Column, enriched: Column) -> Column:
    """A policy source whose feed asks for its PDF documents."""
    return is_policy_source(source_id) & F.coalesce(enriched, F.lit(False))
