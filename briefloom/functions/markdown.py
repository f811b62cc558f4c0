"""Pages that a proxy gives as markdown: a head of named lines, then the article with its pictures and links.

Defined cases: null and empty texts have no title, date, pictures or text; without the mark all of the text is the article; a link or
picture that does not close stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import article, pictures, url
from briefloom.functions.article import stripped
from briefloom.functions.similarity import bound
from briefloom.functions.text import filled, once, single_blanks, where_held

# The mark before the article, pictures and links, and how a paper's page begins its title.
CONTENT = "Markdown Content:"
PICTURE = r"(?U)!\[([^\]]*)\]\(([^)\s]++)[^)]*+\)"
LINK = r"(?U)\[([^\]]*)\]\(([^)\s]++)[^)]*+\)"
PAPER_PAGE = r"(?iU)^Paper page\s*[-–—]\s*"
# Most characters of an article.
MOST_CHARS = 15_000


def content(markdown: Column) -> Column:
    """What follows the mark, or all of the text without one."""
    text = F.coalesce(markdown, F.lit(""))
    at = F.instr(text, CONTENT)
    return F.when(at > 0, F.substr(text, at + len(CONTENT))).otherwise(text)


def head(markdown: Column, name: str) -> Column:
    """The value of a named line of the head; empty without one."""
    return stripped(F.regexp_extract(F.coalesce(markdown, F.lit("")), rf"(?Umd)^{name}:\s*([^\n]+)$", 1))


def pictures_in(text: Column, page: Column, most: int = pictures.MOST) -> Column:
    """The first pictures (``url``, ``alt``) that are content, each address once, parameters aside."""
    read = lambda mark, i: F.regexp_extract(mark, PICTURE, i)
    found = lambda mark: F.struct(url.absolute(page, read(mark, 2)).alias("url"), F.left(read(mark, 1), F.lit(pictures.ALT_CHARS)).alias("alt"))
    taken = lambda kept, mark: bound(found(mark), lambda x: F.when(pictures.is_picture(x["url"]), pictures.first_distinct(F.concat(kept, F.array(x)), most)).otherwise(kept))
    # Only as many are read as are kept.
    return F.aggregate(F.regexp_extract_all(text, F.lit(PICTURE), 0), F.array().cast(pictures.PICTURE), lambda kept, mark: F.when(F.size(kept) < most, taken(kept, mark)).otherwise(kept))


def paragraphs(text: Column) -> Column:
    """Markdown as paragraphs: no pictures, links as their text, one mark less on headings, no rules, one blank within lines."""
    text = where_held(text, "](", (PICTURE, " "), (LINK, "$1"))
    text = where_held(text, "#", (r"(?Umd)^#{2,6}\s*", "## "), (r"(?Umd)^#\s*", ""))
    text = single_blanks(F.regexp_replace(text, r"(?Umd)^\s*[-*=_]{3,}\s*$", ""))
    return stripped(where_held(text, "\n\n\n", ("\n{3,}", "\n\n")))


def article_of_markdown(markdown: Column, page: Column, title: Column, most: Column | int = MOST_CHARS) -> Column:
    """(``text``, ``images``): the article without labels and what leads in, at most ``most`` characters, and its pictures."""
    body = content(markdown)
    text = article.drop_leading(article.drop_labels(paragraphs(body)), title)
    return F.struct(F.left(text, F.lit(most) if isinstance(most, int) else most).alias("text"), pictures_in(body, page).alias("images"))


def proxy_items(pages: DataFrame) -> DataFrame:
    """Items of pages that a proxy gave as markdown: (``url``, ``title``, ``body``, ``images``, ``published_raw``) and all other columns.

    ``pages`` has ``markdown``, ``url``, ``title``, ``published_raw`` and ``community_block``. The page's own title and the list's own
    date win; a block of comments follows the article, which gives it room. Pages without text, address or title are none.
    """
    pages = once(pages, markdown=F.coalesce("markdown", F.lit("")))
    own = filled(stripped(F.regexp_replace(head(F.col("markdown"), "Title"), PAPER_PAGE, "")))
    block = F.coalesce("community_block", F.lit(""))
    room = F.when(block != "", F.greatest(F.lit(MOST_CHARS - 2) - F.length(block), F.lit(0))).otherwise(F.lit(MOST_CHARS))
    named = pages.where("markdown <> ''").withColumns({"title": F.coalesce(own, "title", F.lit("")), "published_raw": F.coalesce(filled(F.col("published_raw")), head(F.col("markdown"), "Published Time"))})
    parsed = once(named.where("title <> '' AND url <> ''"), _article=article_of_markdown(F.col("markdown"), F.col("url"), F.col("title"), room))
    text = F.col("_article.text")
    body = F.when(block != "", F.concat(text, F.lit("\n\n"), block)).otherwise(text)
    return parsed.withColumns({"body": body, "images": F.col("_article.images")}).drop("_article", "markdown", "community_block")
