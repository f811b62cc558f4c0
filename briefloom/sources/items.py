"""Raw items from files: feeds, pages, JSON listings and PDF bytes, with the projections that make them items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.functions import dates, pictures, text, url
from briefloom.schema import FEEDS

RSS_ITEM = "title string, link string, guid string, description string, pubDate string, published string, updated string, category array<string>, enclosure struct<_url: string, _type: string, _length: long>"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """The configured sources; a dimension table of their number."""
    return spark.read.schema(FEEDS).parquet(path)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """One row an item of the RSS files under ``path``, with the file it came from; broken items have null fields."""
    rows = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(RSS_ITEM).load(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def published_raw(published: Column, pub_date: Column, updated: Column, allow_updated: Column) -> Column:
    """The publication date as it stands; the date of an update only where the source allows it."""
    return F.coalesce(text.filled(published), text.filled(pub_date), F.when(allow_updated, text.filled(updated)), F.lit(""))


def rss_items(rows: DataFrame, now_ms: int) -> DataFrame:
    raw = published_raw(F.col("published"), F.col("pubDate"), F.col("updated"), F.lit(False))
    return rows.select("file", F.col("title"), F.col("link").alias("url"), F.col("description").alias("body"), raw.alias("published_raw"), dates.parse_date_ms(raw, now_ms).alias("published_ms"), F.col("guid").alias("podcast_guid"), F.col("enclosure._url").alias("audio_url"), F.col("category").alias("entry_tags"))


def read_json_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def page_items(pages: DataFrame, least_chars: int = 40) -> DataFrame:
    """Items of stored pages: title, text, date and images; pages without title or with a short body are no items."""
    from briefloom.functions import html

    rows = pages.select("page_id", "url", text.strip_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), html.article_text("html").alias("body"), dates.published_in_html(F.col("html")).alias("published_raw"), pictures.pictures_of(F.col("html"), F.col("url")).alias("images"))
    return rows.where((F.col("title") != "") & (F.length("body") >= least_chars))


def page_links(pages: DataFrame, include: list[str], exclude: list[str], most: int) -> DataFrame:
    """Links of list pages to articles on the same host, newest paths first, at most ``most`` a page."""
    from pyspark.sql import Window

    links = pages.select("page_id", F.col("url").alias("page"), F.explode(url.hrefs(F.col("html"))).alias("target"))
    links = links.withColumn("link", url.absolute(F.col("page"), F.col("target"))).withColumn("where", url.path(F.col("link")))
    kept = links.where((url.host(F.col("link")) == url.host(F.col("page"))) & url.path_allowed(F.col("where"), include, exclude) & url.depth_ok(F.col("where")))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(url.recency_key(F.col("where"))), "link"))
    return kept.withColumn("nth", rank).where(F.col("nth") <= most).select("page_id", "link", "nth")


def read_pdfs(spark: SparkSession, path: str, most_bytes: int = 40_000_000) -> DataFrame:
    """PDF files by their first bytes and size; reading their text needs a library that is a parameter of the caller."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.where((F.col("length") <= most_bytes) & (F.substring("content", 1, 4) == F.encode(F.lit("%PDF"), "UTF-8")))
