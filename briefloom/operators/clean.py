"""The clean funnel: one ordered CASE names why an item is dropped; then dedup, caps and the anti join on stored keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.config import DAY_MS, HOUR_MS, EngineConfig
from briefloom.functions import text, url

#: Reasons in the order of their tests.
REASONS = ("missing_title_url", "title_exclude_regex", "missing_or_invalid_date", "lookback", "min_content_chars", "keyword_regex", "typed_filter", "dup_round", "per_feed_cap")


def window_hours(hours: Column, default: int = 168) -> Column:
    """Hours of a source; zero and null mean the default."""
    return F.coalesce(F.nullif(hours, F.lit(0)), F.lit(default))


def in_lookback(published_ms: Column, hours: Column, now_ms: int, hot: Column) -> Column:
    """Published within the window, whose far edge is outside; hot items pass."""
    return F.coalesce(hot, F.lit(False)) | (F.lit(now_ms) - published_ms < window_hours(hours) * HOUR_MS)


def in_selection_window(published_ms: Column, hours: Column, now_ms: int) -> Column:
    """Within min(7 days, the source's hours), whose far edge is inside, and at most two days ahead."""
    reach = F.least(F.lit(168), F.greatest(F.lit(1), window_hours(hours))) * HOUR_MS
    return published_ms.between(F.lit(now_ms) - reach, F.lit(now_ms + 2 * DAY_MS))


def can_backfill(link: Column) -> Column:
    return link.rlike("^https?://") & ~link.contains("arxiv.org/")


def valid_feeds(feeds: DataFrame) -> DataFrame:
    """Configured feeds whose regular expressions compile; those that do not are null, so that the default holds."""
    return feeds.withColumns({c: text.valid_pattern(F.col(c)) for c in ("keyword_regex", "title_exclude_regex") if c in feeds.columns})


def tag_reasons(items: DataFrame, config: EngineConfig, typed_reason: Column | None = None) -> DataFrame:
    """Adds drop_reason (null for kept items), needs_fulltext and window_only.

    Items need: title, url, body, published_ms, heat_keep, fetch_method, lookback_hours, keyword_regex,
    keyword_min_hits, title_exclude_regex, min_content_chars. A pattern that does not compile counts as none. ``window_only`` marks items
    that only their age drops.
    """
    title, link = text.strip_html(F.col("title")), url.normalize_url(F.col("url"))
    body, method = F.coalesce(F.col("body"), F.lit("")), F.col("fetch_method")
    least = F.coalesce(F.nullif(F.col("min_content_chars"), F.lit(0)), F.lit(config.least_chars))
    short = (F.length(F.concat_ws(" ", title, body)) < least) & ~method.isin("Media", "Social")
    pattern = F.coalesce(text.valid_pattern(F.col("keyword_regex")), F.lit(config.keyword_regex))
    hits = F.coalesce(F.nullif(F.col("keyword_min_hits"), F.lit(0)), F.lit(1))
    relevant = F.when(method == "Podcast", text.podcast_keyword_ok(title, body, pattern, hits)).otherwise(text.keyword_ok(title, body, pattern, hits))
    excluded = text.valid_pattern(F.col("title_exclude_regex"))
    before = F.when((title == "") | (link == ""), "missing_title_url").when(F.coalesce(F.regexp_like(title, F.concat(F.lit("(?i)"), excluded)), F.lit(False)), "title_exclude_regex").when(F.col("published_ms").isNull(), "missing_or_invalid_date")
    late = ~in_lookback(F.col("published_ms"), F.col("lookback_hours"), config.now_ms, F.col("heat_keep"))
    after = F.when(short & ~can_backfill(link), "min_content_chars").when(~method.isin("Bridge", "Social") & ~relevant, "keyword_regex").when(typed_reason if typed_reason is not None else F.lit(False), "typed_filter")
    return items.withColumns(
        {
            "clean_title": title,
            "clean_url": link,
            "drop_reason": F.coalesce(before, F.when(late, "lookback"), after),
            "needs_fulltext": short & can_backfill(link),
            "window_only": before.isNull() & late & after.isNull(),
        }
    )


def mark_repeats(tagged: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of kept items with equal keys the first stays; the others get ``dup_round``. Blank keys are never repeats."""
    rank = F.row_number().over(Window.partitionBy("_kept", key).orderBy(*order))
    repeated = F.col("drop_reason").isNull() & ~text.blank(F.col(key)) & (rank > 1)
    return tagged.withColumn("_kept", F.col("drop_reason").isNull()).withColumn("drop_reason", F.when(repeated, "dup_round").otherwise(F.col("drop_reason"))).drop("_kept")


def mark_over_cap(tagged: DataFrame, feed: str, most: int, order: list[str]) -> DataFrame:
    """Of a feed's kept items those behind the first ``most`` get ``per_feed_cap``."""
    rank = F.row_number().over(Window.partitionBy("_kept", feed).orderBy(*order))
    over = F.col("drop_reason").isNull() & (rank > most)
    return tagged.withColumn("_kept", F.col("drop_reason").isNull()).withColumn("drop_reason", F.when(over, "per_feed_cap").otherwise(F.col("drop_reason"))).drop("_kept")


def clean(items: DataFrame, config: EngineConfig, key: str, feed: str, order: list[str], typed_reason: Column | None = None) -> DataFrame:
    """The whole funnel in its declarative order: reasons, then repeats across feeds, then the cap of each feed."""
    tagged = tag_reasons(items, config, typed_reason)
    return mark_over_cap(mark_repeats(tagged, key, order), feed, config.kept_per_feed, order)


def funnel(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def kept_items(tagged: DataFrame, config: EngineConfig) -> DataFrame:
    return tagged.where(F.col("drop_reason").isNull()).withColumn("body", F.left(F.col("body"), F.lit(config.most_body_chars)))


def new_items(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Items whose key is not stored; a blank key never meets one."""
    known = stored.select(text.filled(F.col(key)).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    return items.join(known, text.filled(F.col(key)) == F.col("_known"), "left_anti")


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_of_stratum(rows: DataFrame, stratum: Column, most: int, order: list) -> DataFrame:
    """The first ``most`` rows where ``stratum`` holds, and all others."""
    held = F.coalesce(stratum, F.lit(False))
    inside, outside = rows.where(held), rows.where(~held)
    return outside.unionByName(inside.orderBy(*order).limit(most))


def keep_trending(published_ms: Column, upvotes: Column, stars: Column, least_upvotes: int, now_ms: int, fresh_days: int = 7, most_days: int = 30, hot: int = 100) -> Column:
    """(keep, heat_keep): fresh papers stay unless voted below the least; older ones up to a month if they are hot."""
    age = (F.lit(now_ms) - published_ms) / DAY_MS
    outcome = lambda keep, heat: F.struct(keep.alias("keep"), heat.alias("heat_keep"))
    no, yes = F.lit(False), F.lit(True)
    weak = (upvotes > 0) & (upvotes < least_upvotes)
    heated = (upvotes >= hot) | (stars >= hot)
    return F.when(published_ms.isNull(), outcome(no, no)).when(age <= fresh_days, outcome(~weak, no)).when(age > most_days, outcome(no, no)).when(heated, outcome(yes, yes)).otherwise(outcome(no, no))


def within_budget(rows: DataFrame, group: str, order: list, size: str, most: int) -> DataFrame:
    """Rows of a group in order until their sizes sum up to more than the budget; the first always stays."""
    window = Window.partitionBy(group).orderBy(*order)
    total = F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_total": total, "_nth": F.row_number().over(window)}).where((F.col("_total") <= most) | (F.col("_nth") == 1)).drop("_total", "_nth")
