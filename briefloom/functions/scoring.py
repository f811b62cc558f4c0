"""Explainable scores: papers, social posts, repositories, preference among members of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a paper's title and abstract with their points; each counts once.
PAPER_POINTS = [
    (r"\b(state[- ]of[- ]the[- ]art|sota)\b", 12),
    (r"\b(benchmark|leaderboard)\b", 8),
    (r"\b(open[- ]source|released? (?:code|model|weights))\b", 10),
    (r"\b(foundation model|large language model|\bllm\b|multimodal|agentic)\b", 8),
    (r"\b(reasoning|planning|tool[- ]use|rlhf|dpo|grpo|moe)\b", 8),
    (r"\b(outperform|surpass|beats?|improves? over)\b", 6),
    (r"\b(neurips|iclr|icml|cvpr|eccv|acl|emnlp|aaai|nature|science|jmlr)\b", 15),
    (r"\b(lecture notes?|homework|course(?:work| project)|problem set|tutorial slides?)\b", -45),
    (r"\b(undergraduate|course project|class project|term paper)\b", -35),
    (r"\b(retracted|withdrawn|duplicate submission)\b", -50),
    (r"\b(position paper|opinion|perspective only)\b", -8),
    (r"\b(preliminary|work in progress|extended abstract)\b", -10),
]
#: The letters that a hit of each pattern begins with: a search tries the pattern at these places alone.
PAPER_LETTERS = ("s", "bl", "or", "flma", "rptdgm", "osbi", "niceasj", "lhcpt", "uct", "rwd", "po", "pwe")
CODE_LINK = r"(?i)(?:github\.com|gitlab\.com)/[\w.-]+/[\w.-]+|huggingface\.co/(?:spaces|models|datasets)/[\w.-]+|(?:https?://)?[\w.-]+\.github\.io/"
KNOWN_VENUES = r"(?i)\b(neurips|nips|iclr|icml|acl|emnlp|naacl|eacl|coling|findings|cvpr|eccv|iccv|wacv|aaai|ijcai|kdd|www|sigir|recsys|nature|science|jmlr|tmlr|icra|iros|rss|mlsys|uist|chi|chil)\b"
# What makes a post a strong signal, a technical one, noise, and evidence.
STRONG = r"(?i)\b(announce|announcing|introduc(?:e|ing)|launch|release[sd]?|now available|open[- ]source|api|pricing|price|model|weights?|security|vulnerabilit|license|benchmark|paper|research|acqui|funding)\b|(发布|上线|推出|开源|模型|权重|接口|价格|安全|漏洞|许可|论文|研究|融资|收购)"
TECHNICAL = r"(?i)\b(ai|llm|agent|reasoning|inference|training|multimodal|robot|gpu|transformer|rag|benchmark|dataset|eval|safety)\b|(人工智能|大模型|智能体|推理|训练|多模态|机器人|算力|评测|数据集|安全)"
NOISE = r"(?i)\b(giveaway|hiring|we'?re hiring|join us|happy birthday|good morning|register now|last chance|see you there)\b|(抽奖|招聘|加入我们|生日快乐|早上好|立即报名|最后机会|不见不散)"
LINKED = r"(?i)https?://\S+"
CODED = r"(?i)(github\.com|huggingface\.co|arxiv\.org|doi\.org)"
NUMBERED = r"(?i)(?<!\w)\d+(?:\.\d+)?%?|[$￥¥]\s*\d+"


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def points(holds: Column, value) -> Column:
    return F.when(holds, F.lit(value)).otherwise(F.lit(0))


def paper_signal(title: Column, body: Column, url: Column) -> Column:
    """50 points, more or less for code, length and patterns, within 0 to 100."""
    text, length = F.concat_ws("\n", title, body, url), F.length(F.coalesce(body, F.lit("")))
    total = 50 + points(text.rlike(CODE_LINK), 15) + F.when(length >= 800, 5).when(length < 200, -10).otherwise(0)
    for (pattern, value), letters in zip(PAPER_POINTS, PAPER_LETTERS, strict=True):
        total = total + points(text.rlike(f"(?i)(?=[{letters}]){pattern}"), value)
    return clamp(total).cast("int")


def log_score(value: Column, cap: float) -> Column:
    return F.when(value <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), 100.0 * F.log1p(value) / F.log1p(F.lit(float(cap)))))


def community_heat(upvotes: Column, comments: Column) -> Column:
    return F.bround(F.least(F.lit(100.0), 0.6 * log_score(upvotes, 500) + 0.4 * log_score(comments, 80)), 1)


def venue_score(venue: Column, liked: Column, disliked: Column) -> Column:
    """(score, reason) of an accepted venue against two lists of name parts."""
    name = F.lower(F.coalesce(venue, F.lit("")))
    within = lambda names: F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda v: (v != "") & F.contains(name, F.lower(v)))
    outcome = lambda score, reason: F.struct(F.lit(float(score)).alias("score"), F.lit(reason).alias("reason"))
    return (
        F.when((name != "") & within(disliked), outcome(0, "blacklisted"))
        .when(name == "", outcome(20, "no_acceptance"))
        .when(within(liked), outcome(100, "whitelist"))
        .otherwise(outcome(60, "accepted_other"))
    )


def accepted_venue(comment: Column, journal: Column) -> Column:
    """A known venue named behind ``accepted at`` or ``to appear in``, else a known journal, else empty."""
    said = F.concat_ws(" ", F.coalesce(comment, F.lit("")), F.coalesce(journal, F.lit("")))
    found = F.regexp_extract_all(said, F.lit(r"(?i)(?:accepted|to\s+appear)\s*(?:to|at|in|:)?\s*([^\n.;]{3,80})"), 1)
    trimmed = F.transform(found, lambda v: F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"(?i)\b(as a|poster|oral|spotlight|workshop)\b.*$", ""), r"^[ .,;:|/\\]+|[ .,;:|/\\]+$", ""), F.lit(80)))
    known = F.filter(trimmed, lambda v: v.rlike(KNOWN_VENUES))
    fallback = F.when(journal.rlike(KNOWN_VENUES), F.left(F.trim(F.regexp_replace(journal, r"\s+", " ")), F.lit(80))).otherwise("")
    return F.coalesce(F.get(known, 0), fallback, F.lit(""))


def whole_quality(venue: Column, community: Column, signal: Column, community_known: Column) -> Column:
    """Weights .40, .25 and .35; without community data the other two make up the whole. Not rounded: what a threshold is held against."""
    with_all = 0.40 * venue + 0.35 * signal + 0.25 * community
    without = (0.40 * venue + 0.35 * signal) / 0.75
    return F.least(F.lit(100.0), F.when(community_known, with_all).otherwise(without))


def quality(venue: Column, community: Column, signal: Column, community_known: Column) -> Column:
    """The same as it is shown, to one place."""
    return F.bround(whole_quality(venue, community, signal, community_known), 1)


def engagement(likes: Column, replies: Column, reposts: Column, quotes: Column, bookmarks: Column) -> Column:
    zero = F.lit(0)
    parts = [F.coalesce(c, zero) for c in (likes, replies, reposts, quotes, bookmarks)]
    return parts[0] + 2 * (parts[1] + parts[2] + parts[3]) + parts[4]


def novelty_points(similarity: Column) -> Column:
    """20, 12, 4 or 0 points up to a similarity of .35, .65, .85 or more; 20 without texts to compare with."""
    return F.when(similarity.isNull() | (similarity < 0.35), 20).when(similarity < 0.65, 12).when(similarity < 0.85, 4).otherwise(0)


def social_evidence(text: Column, has_media: Column, thread: Column) -> Column:
    total = points(text.rlike(LINKED), 8) + points(text.rlike(CODED), 6) + points(text.rlike(NUMBERED), 4) + points(has_media, 4) + points(thread > 1, 4)
    return F.least(F.lit(20), total)


def engagement_points(amount: Column, age_hours: Column, followers: Column, baseline: Column) -> Column:
    """Up to 15 points for engagement an hour against the account's baseline or its reach."""
    speed = amount / F.greatest(F.lit(0.5), F.coalesce(age_hours, F.lit(24.0)))
    ratio = F.when(F.coalesce(baseline, F.lit(0.0)) > 0, speed / baseline).otherwise(speed / F.greatest(F.lit(1.0), F.greatest(F.lit(1.0), F.coalesce(followers, F.lit(0.0))) / 10000))
    return clamp(F.bround(5 * F.log2(1 + ratio)), 0, 15).cast("int")


def social_score(tier: Column, text: Column, has_media: Column, thread: Column, novelty: Column, engaged: Column) -> Column:
    account = F.when(tier == "P0", 20).when(tier == "P1", 12).otherwise(6)
    intent = F.when(text.rlike(STRONG), 25).when(text.rlike(TECHNICAL), 18).otherwise(8)
    return clamp(account + intent + social_evidence(text, has_media, thread) + novelty + engaged).cast("int")


# Points by tier.
TIER_POINTS = {"L1": 40, "L2": 25, "L3": 12, "L4": 5}


def prefer(tier: Column, priority: Column, source_type: Column, stamp: Column, body_length: Column) -> Column:
    """(points, earlier first, longer first) to order members of one event by, descending; an unknown tier counts as L3."""
    code, level = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (tier, priority))
    kind = F.coalesce(source_type, F.lit(""))  # as written, unlike the others
    by_tier = F.lit(12)
    for name, points_of in reversed(TIER_POINTS.items()):
        by_tier = F.when(F.contains(code, F.lit(name)), points_of).otherwise(by_tier)
    by_priority = F.when(level == "P0", 30).when(level == "P1", 18).otherwise(8)
    kind = F.when(kind.isin("纯网页", "Company Blog") | F.contains(kind, F.lit("官方")), 6).when(kind.isin("论文", "Research"), -2).otherwise(0)
    return F.struct((by_tier + by_priority + kind).alias("points"), (-stamp).alias("earlier"), body_length.alias("length"))


def repo_score(stars: Column, forks: Column, is_new: Column, on_topic: Column, pushed: Column, wrapper: Column) -> Column:
    return F.log10(stars + 1) + 0.5 * F.log10(forks + 1) + points(is_new, 1.2) + points(on_topic, 0.5) + points(pushed, 0.3) - points(wrapper, 0.5)


def final_quality(base: Column, model: Column) -> Column:
    return F.when(model.isNull(), base).otherwise(F.bround(0.6 * base + 0.4 * model, 1))


def display_weight(content_type: Column) -> Column:
    return F.when(content_type == "视频", 0.9).when(content_type == "播客", 0.85).otherwise(1.0)


def translate_limit(priority: Column, impact: Column) -> Column:
    return F.when((priority == "P0") | (impact >= 80), 12_000).when((priority == "P1") | (impact >= 60), 6_000).otherwise(3_000)

