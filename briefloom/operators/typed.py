"""Filters by the kind of source: the first of an ordered list of tests that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Threshold and metric of the numeric tests, in order.
NUMERIC = [
    ("min_impact_factor", "impact_factor"),
    ("min_read_count", "read_count"),
    ("min_views", "views"),
    ("min_followers", "followers"),
    ("min_engagement", "engagement"),
    ("min_duration_sec", "duration_sec"),
    ("min_signal_score", "signal_score"),
    ("min_quality_score", "quality_score"),
    ("min_community_heat", "community_heat"),
]


def typed_reason(entity: Column, params: dict[str, Column], metrics: dict[str, Column], text: Column, body_length: Column) -> Column:
    """The reason to drop an item, or null; tests without a parameter or without a metric do not apply.

    A threshold of zero and a false switch count as absent, as in the stored tables.
    """
    nothing = F.lit(None)
    p = lambda name: params.get(name, nothing)
    m = lambda name: metrics.get(name, nothing)
    on = lambda name: F.coalesce(p(name).cast("boolean"), F.lit(False))
    is_true = lambda name: F.coalesce(m(name).cast("boolean"), F.lit(False))
    listed = lambda name: F.coalesce(p(name).cast("array<string>"), F.array().cast("array<string>"))
    given = lambda name: F.size(listed(name)) > 0
    within = lambda name, hay: F.exists(listed(name), lambda t: F.contains(hay, t))
    threshold = lambda name: F.nullif(p(name).cast("double"), F.lit(0.0))
    venue = F.lower(F.coalesce(m("accepted_venue").cast("string"), F.lit("")))
    account = F.lower(F.coalesce(m("account").cast("string"), F.lit("")))
    paper, social = entity == "paper", F.coalesce(entity == "social", F.lit(False))
    least_chars = F.coalesce(threshold("min_abstract_chars"), threshold("min_content_chars"))
    tests: list[tuple[Column, str]] = [
        (given("keyword_include") & ~within("keyword_include", text), "keyword_include"),
        (within("keyword_exclude", text), "keyword_exclude"),
        (body_length < least_chars, "min_chars"),
        (paper & given("venue_whitelist") & (venue != "") & ~within("venue_whitelist", venue), "venue_whitelist"),
        (paper & within("venue_blacklist", F.concat_ws(" ", venue, F.lower(text))), "venue_blacklist"),
        (given("account_whitelist") & (account != "") & ~within("account_whitelist", account), "account_whitelist"),
        (given("channel_whitelist") & (account != "") & ~within("channel_whitelist", account), "channel_whitelist"),
    ]
    for limit, metric in NUMERIC:
        fails = m(metric).cast("double") < threshold(limit)
        if limit == "min_followers":
            fails = fails & ~social
        elif limit == "min_engagement":
            fails = fails & ~(social & is_true("strong_signal"))
        tests.append((fails, limit))
    tests += [
        (m("duration_sec").cast("double") > threshold("max_duration_sec"), "max_duration_sec"),
        (on("require_community_heat") & (venue == "") & (F.coalesce(m("community_heat").cast("double"), F.lit(0.0)) <= 0), "require_community_heat"),
        (on("exclude_preprint") & is_true("is_preprint"), "exclude_preprint"),
        (on("require_code") & ~is_true("has_code"), "require_code"),
        (on("exclude_ad") & is_true("is_ad"), "exclude_ad"),
        (on("exclude_retweets") & is_true("is_retweet"), "exclude_retweets"),
        (on("require_acceptance") & (venue == ""), "require_acceptance"),
        (F.coalesce(m("venue_reason").cast("string") == "blacklisted", F.lit(False)), "venue_blacklist"),
    ]
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for test, reason in tests])


def first_wins(configs: list[DataFrame], key: str) -> DataFrame:
    """One table of typed configurations; of rows with the same key the earlier table's counts, then the earlier row."""
    union = None
    for i, config in enumerate(configs):
        part = config.withColumn("_table", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    order = [c for c in union.columns if c not in (key, "_table")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_table", *order))
    return union.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_table")
