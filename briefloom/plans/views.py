"""Views that give the test tables the roles of the engine's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which all registered queries run: 2024-01-31 00:00 UTC.
NOW_MS = 1_706_659_200_000
START_MS = 1_704_067_200_000
KINDS = {"purchase": "论文", "view": "视频", "click": "播客", "signup": "Github热榜", "error": "文章"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """Documents with the event of the same number: quality, account and kind; published times spread over a month.

    ``text`` stands for the documents' text where a query needs less of it, so that no whole texts go through the join.
    """
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    if text is not None:
        docs = docs.withColumn("text", text)
    n = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    kind = F.lit("文章")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return docs.join(events, docs.doc_id == events.event_id).select(
        "doc_id",
        F.col("source").alias("source_id"),
        "lang",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        (START_MS + (F.col("doc_id") * 7919 % 43200) * 60_000).alias("published_ms"),
        F.col("value").alias("quality"),
        F.col("user_id").alias("account"),
        "event_type",
        kind.alias("content_type"),
        n.alias("n"),
        F.concat(F.lit("P"), (n % 3).cast("string")).alias("priority"),
        F.concat(F.lit("L"), (n % 4 + 1).cast("string")).alias("tier"),
    )


def sources_dim(spark: SparkSession) -> DataFrame:
    """25 sources, of which the documents use 20."""
    n = F.col("id").cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)
    return spark.range(25).select(
        F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_id"),
        n.alias("n"),
        pick(("paused", "experimental", "active", "active", "active")).alias("status"),
        pick(("RSS", "Scrape", "Media", "Social", "Podcast")).alias("fetch_method"),
        pick((168, 72, 24, 240)).alias("lookback_hours"),
    )


ENTRIES = f"""entries AS (
  SELECT d.doc_id, d.source AS source_id, d.lang, split_part(d.text, chr(10), 1) AS title, d.text AS body,
    {START_MS} + (d.doc_id * 7919 % 43200) * 60000 AS published_ms, e.value AS quality, e.user_id AS account, e.event_type,
    CASE e.event_type WHEN 'purchase' THEN '论文' WHEN 'view' THEN '视频' WHEN 'click' THEN '播客' WHEN 'signup' THEN 'Github热榜' ELSE '文章' END AS content_type,
    CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INT) AS n,
    'P' || CAST(CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INT) % 3 AS VARCHAR) AS priority,
    'L' || CAST(CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INT) % 4 + 1 AS VARCHAR) AS tier
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""
SOURCES = """sources_dim AS (
  SELECT 'src' || CAST(i AS VARCHAR) AS source_id, CAST(i AS INT) AS n,
    (['paused', 'experimental', 'active', 'active', 'active'])[i % 5 + 1] AS status,
    (['RSS', 'Scrape', 'Media', 'Social', 'Podcast'])[i % 5 + 1] AS fetch_method,
    ([168, 72, 24, 240])[i % 4 + 1] AS lookback_hours
  FROM (SELECT unnest(range(25)) AS i))"""
