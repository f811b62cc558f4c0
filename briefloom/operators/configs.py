"""Items and feeds beside their typed configuration, carriers computed anew, and analyses that are still valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import classify
from briefloom.functions.text import blank

#: Fixed value: analyses of papers before this version are made again.
PAPER_ANALYSIS_VERSION = 2


def with_config(items: DataFrame, configs: DataFrame, key: str = "source_id") -> DataFrame:
    """Each item beside its source's typed configuration; items without one keep nulls. ``configs`` has one row a source."""
    return items.join(configs, key, "left")


def prepared_feeds(feeds: DataFrame, configs: DataFrame) -> DataFrame:
    """Feeds with the carrier that their typed configuration implies (``source_type``) and their diagnostic group (``cohort``).

    ``feeds``: ``source_id``, ``url``, ``category``, ``source_type``; ``configs``: ``source_id``, ``entity_type``, one row a source.
    """
    implied = classify.signal_format(F.col("source_id"), F.col("url"), F.lit("Scrape"), F.col("entity_type"), F.col("source_type"))
    return (
        with_config(feeds, configs)
        .withColumn("source_type", F.when(blank(F.col("entity_type")), F.col("source_type")).otherwise(implied))
        .withColumn("cohort", classify.cohort(F.col("source_id"), F.col("category"), F.col("url")))
    )


def long_enough(body: Column, needs_fulltext: Column, least: Column) -> Column:
    """Items let through as summaries must reach the least length once their text has been fetched."""
    short = F.length(F.coalesce(body, F.lit(""))) < F.coalesce(least, F.lit(0))
    return ~(F.coalesce(needs_fulltext, F.lit(False)) & short)


def refreshed(rows: DataFrame, stored: str, fresh: Column) -> DataFrame:
    """Rows with ``fresh`` beside the stored value, and whether the row is to be written (``changed``)."""
    return rows.withColumn("fresh", fresh).withColumn("changed", ~F.col(stored).eqNullSafe(F.col("fresh")))


def refresh_counts(rows: DataFrame, stored: str) -> DataFrame:
    """How many rows carry each value before and after, and how many change: (value, before, after, changed)."""
    sides = F.array(
        F.struct(F.coalesce(F.nullif(F.col(stored), F.lit("")), F.lit("(empty)")).alias("value"), F.lit(1).alias("before"), F.lit(0).alias("after"), F.lit(0).alias("changed")),
        F.struct(F.coalesce(F.nullif(F.col("fresh"), F.lit("")), F.lit("(empty)")).alias("value"), F.lit(0).alias("before"), F.lit(1).alias("after"), F.col("changed").cast("int").alias("changed")),
    )
    one = rows.select(F.inline(sides))
    return one.groupBy("value").agg(*(F.sum(c).alias(c) for c in ("before", "after", "changed")))


def analysis_valid(status: Column, summary: Column, content_type: Column, metrics: Column) -> Column:
    """Whether a stored analysis may be used again: done, with a summary, of the present version, and no older than its evidence."""
    number = lambda path: F.coalesce(F.get_json_object(metrics, path).try_cast("int"), F.lit(0))
    old_paper = (content_type == "论文") & (number("$.llm.analysis_version") < PAPER_ANALYSIS_VERSION)
    from_pdf = F.get_json_object(metrics, "$.full_text.source") == "pdf"
    old_evidence = from_pdf & (number("$.llm.evidence_version") < number("$.full_text.version"))
    no = F.lit(False)
    return (F.coalesce(status, F.lit("")) == "已分析") & ~blank(summary) & ~F.coalesce(old_paper, no) & ~F.coalesce(old_evidence, no)


def with_cached(items: DataFrame, cache: DataFrame, key: str, valid: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Items with their analysis, from the cache where that is valid, and by ``compute`` for the remainder alone.

    ``cache`` has one row a key; ``compute`` adds the cache's other columns. Items with a null key are computed. ``cached`` tells which.
    """
    usable = cache.where(F.coalesce(valid, F.lit(False)))
    found = items.join(usable, key).withColumn("cached", F.lit(True))
    fresh = compute(items.join(usable, key, "left_anti")).withColumn("cached", F.lit(False))
    return found.unionByName(fresh)
