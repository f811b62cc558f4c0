"""Media, comments, videos and papers: joins and aggregates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.functions import dates, url
from briefloom.functions.text import filled, unescaped
from briefloom.operators import clean


def thread_media(posts: DataFrame, media: DataFrame, thread: str, place: str) -> DataFrame:
    """Photos and other media of each thread, each key once, in the order of its first post.

    ``posts`` has ``media_keys``; ``media`` has ``media_key``, ``type`` and ``url``, one row a key. Keys that are not in ``media``
    stay with an empty address, among the other media. A thread's media come from its own posts, so a row stays small.
    """
    keys = posts.select(thread, place, F.posexplode("media_keys").alias("nth", "media_key")).where("media_key <> ''")
    first = keys.groupBy(thread, "media_key").agg(F.min(F.struct(place, "nth")).alias("at"))
    known = first.join(media.select("media_key", "type", "url"), "media_key", "left")
    photo = F.coalesce(F.col("type") == "photo", F.lit(False))
    asset = F.struct("at", F.col("media_key").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    in_order = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, asset))), lambda a: F.struct(a["id"].alias("id"), a["url"].alias("url")))
    return known.groupBy(thread).agg(in_order(photo).alias("images"), in_order(~photo).alias("videos"))


def top_comments(comments: DataFrame, video: str, likes: Column, order: list[str], most: int = 5) -> DataFrame:
    """The comments of each video with most likes; null likes count as none."""
    window = Window.partitionBy(video).orderBy(F.coalesce(likes, F.lit(0)).desc(), *order)
    return comments.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def channel_videos(playlist: DataFrame, details: DataFrame, channels: DataFrame) -> DataFrame:
    """The public videos of each channel's playlist, without shorts under a minute and live streams unless the channel takes them.

    ``playlist``: ``channel_id``, ``video_id``, ``place``; ``details``: ``video_id``, ``privacy``, ``seconds``, ``live`` (null: none);
    ``channels``: ``channel_id``, ``include_shorts``, ``include_live``. An unknown length (0 or null) is no short.
    """
    short = (F.col("seconds") > 0) & (F.col("seconds") < 60)
    live = F.coalesce(filled(F.col("live")), F.lit("none")) != "none"
    wanted = lambda holds, name: ~F.coalesce(holds, F.lit(False)) | F.coalesce(F.col(name), F.lit(False))
    public = details.where("privacy = 'public'")
    return playlist.join(public, "video_id").join(channels, "channel_id", "left").where(wanted(short, "include_shorts") & wanted(live, "include_live"))


# Where a page keeps its list as JSON, addresses of papers, links, texts of links that are no titles.
LISTED_PROPS = r'(?i)data-target="DailyPapers"\s+data-props="([^"]*)"'
PAPER_URL = r"(?i)(?:https?://(?:www\.)?(?:huggingface\.co|paperswithcode\.com|paperswithcode\.co))?/papers/(\d{4}\.\d{4,5})(?:v\d+)?"
LINK = r"\[([^\]]*?)\]\((https?://[^\s)]+)\)"
NAVIGATION = (
    r"(?i)^(read more|learn more|home|blog|news|newsroom|research|policy|products?|company|"
    r"about|careers?|contact|privacy|terms|sign in|log ?in|subscribe|share|menu|docs|"
    r"pricing|download|support|next|previous|prev|overview|commitments|learn|try claude|"
    r"sitemap|imprint|accessibility|search|login|footer)$"
)
ENTRY, PAPER = "title string, upvotes string, publishedAt string, paper string", "id string, title string, upvotes string, publishedAt string"


def paper_mentions(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(page, paper, place, title, published, upvotes) of every mention of a paper on a page.

    First come the entries of the page's own list, which it holds as JSON in an attribute, then links to papers, then bare
    addresses. JSON that does not parse, and entries that are no objects, are passed over; values of another type count as
    their text, and votes that are no number as none.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    lists = F.transform(F.regexp_extract_all(text, F.lit(LISTED_PROPS), 1), lambda a: F.from_json(unescaped(a), "dailyPapers array<string>")["dailyPapers"])
    set_of = lambda first, second: F.coalesce(filled(first), filled(second))
    votes = lambda e: set_of(F.when(~e["paper"]["upvotes"].isin("0", "0.0", "false"), e["paper"]["upvotes"]), e["upvotes"]).try_cast("double")
    row = lambda paper, title, published, upvotes: F.struct(paper.alias("paper"), title.alias("title"), published.alias("published"), F.coalesce(upvotes, F.lit(0.0)).alias("upvotes"))
    no = F.lit(None).cast("string")
    own = lambda e: row(F.regexp_extract(F.trim(F.coalesce(e["paper"]["id"], F.lit(""))), r"^(\d{4}\.\d{4,5})(?:v\d+)?$", 1), set_of(e["title"], e["paper"]["title"]), set_of(e["paper"]["publishedAt"], e["publishedAt"]), votes(e))
    # Each value is parsed by itself, so that one of another type costs no other.
    opened = lambda e: F.struct(F.from_json(e, ENTRY).alias("e")).withField("paper", F.from_json(F.from_json(e, ENTRY)["paper"], PAPER))
    flat = lambda x: F.struct(*[x["e"][c].alias(c) for c in ("title", "upvotes", "publishedAt")], x["paper"].alias("paper"))
    listed = F.transform(F.transform(F.transform(F.flatten(F.filter(lists, lambda x: x.isNotNull())), opened), flat), own)
    links = F.zip_with(F.regexp_extract_all(text, F.lit(LINK), 1), F.regexp_extract_all(text, F.lit(LINK), 2), lambda name, target: row(F.regexp_extract(target, PAPER_URL, 1), name, no, F.lit(0.0)))
    bare = F.transform(F.regexp_extract_all(text, F.lit(PAPER_URL), 1), lambda paper: row(paper, no, no, F.lit(0.0)))
    found = pages.select(F.col(id_col).alias("page"), F.posexplode(F.concat(listed, links, bare)).alias("place", "m")).select("page", "place", "m.*").where("paper <> ''")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", " "))
    return found.withColumn("title", F.when(title.rlike(NAVIGATION), "").otherwise(title))


def merged_papers(mentions: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row a paper (of each group) from mentions (``paper``, ``place``, ``title``, ``published``, ``upvotes``): the last title that is set,
    the first date that is set, the most upvotes, and the first place."""
    title = F.when(F.length("title") > 3, F.col("title"))
    return mentions.where("paper <> ''").groupBy(*by, "paper").agg(
        F.max_by(title, F.when(title.isNotNull(), F.col("place"))).alias("title"),
        F.min_by(filled(F.col("published")), F.when(filled(F.col("published")).isNotNull(), F.col("place"))).alias("published"),
        F.coalesce(F.max("upvotes"), F.lit(0.0)).alias("upvotes"),
        F.min("place").alias("place"),
    )


def trending_papers(pages: DataFrame, id_col: str, html: str, now_ms: int, least_upvotes: int = 5, most: int = 8) -> DataFrame:
    """(page, nth, paper, url, title, published_raw, heat_keep, upvotes): the papers of each page's list that are worth a note.

    A listed day after the month of the paper's number is when it came back to the list: the end of that month stands for it.
    The first ``most`` of a page that are kept are shown, in the order of their first mention.
    """
    papers = merged_papers(paper_mentions(pages, id_col, html), ["page"]).withColumn("listed", dates.parse_date_ms(F.col("published"), now_ms))
    dated = papers.withColumn("first", url.first_published_ms(F.col("paper"), F.col("listed")))
    moved = F.date_format(F.timestamp_millis("first"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    outcome = clean.keep_trending(F.col("first"), F.col("upvotes"), F.lit(0), least_upvotes, now_ms)
    rows = dated.withColumns({"published_raw": F.when(F.col("first") < F.col("listed"), moved).otherwise(F.col("published")), "outcome": outcome}).where("outcome.keep")
    nth = F.row_number().over(Window.partitionBy("page").orderBy("place"))
    shown = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    address = F.concat(F.lit("https://huggingface.co/papers/"), F.col("paper"))
    return shown.select("page", "nth", "paper", address.alias("url"), F.left(F.coalesce("title", "paper"), F.lit(200)).alias("title"), "published_raw", F.col("outcome.heat_keep").alias("heat_keep"), "upvotes")


def transcript_index(episodes: DataFrame) -> DataFrame:
    """(key, transcripts): an episode's transcripts under its guid, link and title; of equal keys the last episode wins."""
    keys = F.array_distinct(F.transform(F.array("guid", "link", "title"), lambda k: F.trim(k)))
    listed = F.filter("transcripts", lambda t: F.trim(t["url"]) != "")
    rows = episodes.select(F.explode(keys).alias("key"), "place", listed.alias("transcripts")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("transcripts", "place").alias("transcripts"))


def audio_enclosure(enclosures: Column) -> Column:
    """The first enclosure (``href``, ``type``, ``rel``, ``length``) that is audio or says that it is one; null if there is none."""
    fits = lambda e: (F.coalesce(e["href"], F.lit("")) != "") & (F.coalesce(e["type"], F.lit("")).startswith("audio/") | (F.coalesce(e["rel"], F.lit("")) == "enclosure"))
    return F.get(F.filter(enclosures, fits), F.lit(0))


def entry_image(own: Column, thumbnails: Column, feed: Column) -> Column:
    """An entry's picture: its own, else its first thumbnail with an address, else the feed's; empty if none is set."""
    thumb = F.get(F.filter(thumbnails, lambda u: u != ""), F.lit(0))
    return F.coalesce(filled(own), thumb, filled(feed), F.lit(""))
