"""Pictures of pages: candidates in document order, sizes that tags and names tell, and what a page shows by its type.

All are Column expressions over arrays of tags. Defined cases: null and empty pages have no pictures; a tag without an address, with
inline data or with an address that is no web address is none; pictures are the same if their addresses are, parameters aside;
null arrays count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions import url
from briefloom.functions.article import COVER_NOISE, stripped
from briefloom.functions.similarity import bound
from briefloom.functions.text import filled, unescaped

# Where a tag keeps its address; what addresses, texts and classes of pictures say that are no content.
SOURCES = ("src", "data-src", "data-original", "data-lazy-src")
NO_CONTENT = (
    r"(?i)(logo|icon|avatar|sprite|pixel|spacer|badge|button|tracking|1x1|blank"
    r"|/emoji/|s\.w\.org|gravatar|wp-includes)"
)
CHROME = r"(?iU)\b(logo|icon|avatar|rss|feed|sprite|navbar|nav|header|footer|share|social|subscribe)\b"
# Parts of host names that name no site; sizes in names; the shortest side, a wide one; most pictures, longest text.
COMMON_LABELS = ("www", "com", "org", "net", "edu", "gov", "io", "ai", "co", "cn", "me", "dev", "blog")
NAMED_SIZE = r"(?i)-(\d{2,4})x(\d{2,4})\.(?:jpe?g|png|webp|gif)$"
LEAST_SIDE, WIDE_SIDE, MOST, ALT_CHARS = 200, 600, 4, 120
# Types whose pictures are covers.
VIDEO, PODCAST, ARTICLES = "视频", "播客", ("文章", "公众号", "纯网页")
# Where scripts of a page keep its cover.
SCRIPT_COVERS = (r"""(?is)\bmsg_cdn_url\s*[:=]\s*["']([^"']+)""", r"""(?is)\bcdn_url_1_1\s*[:=]\s*["']([^"']+)""")

PICTURE = "array<struct<url:string,alt:string>>"
ASSET = "array<struct<url:string,alt:string,kind:string>>"


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute; the name also counts as the end of a longer one, as in ``data-src``."""
    return stripped(F.regexp_extract(tag, rf"""(?isU)\b{name}\s*=\s*["']([^"']*)["']""", 1))


def address(tag: Column) -> Column:
    """The tag's address: the first filled source, else the first candidate of its set; empty if there is none."""
    listed = stripped(F.substring_index(attribute(tag, "srcset"), ",", 1))
    return F.coalesce(*[filled(attribute(tag, name)) for name in SOURCES], F.substring_index(listed, " ", 1))


def sides(tag: Column) -> Column:
    """Width and height where the tag states them in pixels; shares and other units are null."""
    pixels = lambda name: F.regexp_extract(attribute(tag, name), r"(?i)^(\d{1,5})(?:\s*px)?$", 1).try_cast("int")
    return F.array(pixels("width"), pixels("height"))


def named_small(link: Column) -> Column:
    """Whether the file's name states a side that is too short."""
    side = lambda i: F.regexp_extract(F.substring_index(link, "?", 1), NAMED_SIZE, i).try_cast("int")
    return F.coalesce(F.least(side(1), side(2)) < LEAST_SIDE, F.lit(False))


def is_picture(link: Column) -> Column:
    """A web address that is no drawing, no logo or other part of a site, and not small by its name."""
    link = F.coalesce(link, F.lit(""))
    drawing = F.endswith(F.lower(F.substring_index(link, "?", 1)), F.lit(".svg"))
    return link.rlike("^https?://") & ~drawing & ~link.rlike(NO_CONTENT) & ~named_small(link)


def is_site_logo(link: Column, page: Column) -> Column:
    """Whether the file is named as the page's site is."""
    file = F.element_at(F.split(url.path(link), "/"), -1)
    stem = F.lower(F.regexp_replace(file, r"\.[^.]*$", ""))
    host = F.lower(F.regexp_extract(page, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    names = F.filter(F.split(host, r"\."), lambda x: ~x.isin(*COMMON_LABELS))
    return (stem != "") & F.array_contains(names, stem)


def first_distinct(found: Column, most: int = MOST) -> Column:
    """The first ``most`` pictures (``url``, ``alt``) whose addresses differ, parameters aside."""
    key = lambda x: F.substring_index(x["url"], "?", 1)
    new = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda k: key(k) == key(x))
    return F.aggregate(found, F.array().cast(PICTURE), lambda kept, x: F.when(new(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def pictures_of(html: Column, page: Column, most: int = MOST) -> Column:
    """The first pictures (``url``, ``alt``) of a page in document order, without logos, icons, pixels and parts of the site.

    What a text or class says is weak evidence, which a wide picture overrules.
    """
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<img\b[^>]*>"), 0)
    read = F.transform(tags, lambda t: F.struct(address(t).alias("raw"), attribute(t, "alt").alias("alt"), attribute(t, "class").alias("style"), sides(t).alias("sides")))
    with_address = F.filter(read, lambda x: (x["raw"] != "") & ~F.startswith(x["raw"], F.lit("data:")))
    full = F.transform(with_address, lambda x: x.withField("url", url.absolute(page, unescaped(x["raw"]))))

    def shown(x: Column) -> Column:
        wide = F.exists(x["sides"], lambda s: F.coalesce(s >= WIDE_SIDE, F.lit(False)))
        small = F.exists(x["sides"], lambda s: F.coalesce(s < LEAST_SIDE, F.lit(False)))
        chrome = F.concat_ws(" ", x["alt"], x["style"]).rlike(CHROME)
        return is_picture(x["url"]) & ~(chrome & ~wide) & ~small & ~is_site_logo(x["url"], page)

    return first_distinct(F.transform(F.filter(full, shown), lambda x: F.struct(x["url"].alias("url"), F.left(unescaped(x["alt"]), F.lit(ALT_CHARS)).alias("alt"))), most)


def script_cover(html: Column, page: Column) -> Column:
    """The cover that a script of the page names, where its meta tags name none; empty if it is no picture of the article."""
    found = F.array(*[F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1) for pattern in SCRIPT_COVERS])
    full = F.transform(F.filter(found, lambda u: u != ""), lambda u: F.replace(url.absolute(page, F.replace(unescaped(u), F.lit("\\/"), F.lit("/"))), F.lit("\\/"), F.lit("/")))
    return F.coalesce(F.get(F.filter(full, lambda u: is_picture(u) & ~u.rlike(COVER_NOISE)), F.lit(0)), F.lit(""))


def is_noise(asset: Column) -> Column:
    """Whether a picture (``url``, ``alt``, ``kind``) is none, or one of an author, a code to scan or an offer."""
    said = F.concat_ws(" ", *[F.coalesce(asset[name], F.lit("")) for name in ("url", "alt", "kind")])
    return ~is_picture(F.trim(F.coalesce(asset["url"], F.lit("")))) | said.rlike(COVER_NOISE)


def display_media(kind: Column, images: Column, thumbnail: Column, current: Column, cover: Column, title: Column) -> Column:
    """(``images``, ``image_url``): what a page shows of an entry by its content type.

    Videos and podcasts show the cover of their platform, articles the cover that their page declares, else one picture
    that is no noise; other types keep all their pictures without noise. ``images`` holds ``url``, ``alt``, ``kind``.
    """
    text = lambda c: stripped(c)
    one = lambda link, label: F.array(F.struct(link.alias("url"), F.coalesce(title, F.lit("")).alias("alt"), F.lit(label).alias("kind")))
    result = lambda found, link: F.struct(found.cast(ASSET).alias("images"), link.alias("image_url"))
    good = lambda u: is_picture(u) & ~u.rlike(COVER_NOISE)
    nothing = F.array().cast(ASSET)

    def by_type(kept: Column) -> Column:
        first = F.coalesce(F.get(kept, F.lit(0))["url"], F.lit(""))
        film, own, declared = F.coalesce(filled(text(thumbnail)), text(current)), F.coalesce(filled(text(current)), first), text(cover)
        left_over = F.when(good(text(current)), text(current)).otherwise(first)
        return (
            F.when((kind == VIDEO) & is_picture(film), result(one(film, "video-cover"), film))
            .when(kind == VIDEO, result(F.slice(kept, 1, 1), text(current)))
            .when((kind == PODCAST) & is_picture(own), result(one(own, "podcast-cover"), own))
            .when(kind == PODCAST, result(F.slice(kept, 1, 1), F.lit("")))
            .when(kind.isin(*ARTICLES) & good(declared), result(one(declared, "article-cover"), declared))
            .when(kind.isin(*ARTICLES) & (left_over != ""), result(one(left_over, "article-cover"), left_over))
            .when(kind.isin(*ARTICLES), result(nothing, F.lit("")))
            .otherwise(result(kept, text(current)))
        )

    return bound(F.filter(F.coalesce(images, nothing), lambda x: ~is_noise(x)), by_type)


def filled_media(images: Column, link: Column, found: Column) -> Column:
    """(``images``, ``image_url``) with pictures found on the page where an entry has none of its own."""
    found = F.coalesce(found, F.array().cast(PICTURE))
    own = F.coalesce(F.size(images) > 0, F.lit(False))
    first = F.coalesce(F.get(found, F.lit(0))["url"], F.lit(""))
    return F.struct(F.when(own, images).otherwise(found).alias("images"), F.when(stripped(link) != "", link).otherwise(first).alias("image_url"))
