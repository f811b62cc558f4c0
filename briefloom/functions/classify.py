"""Inference of topics, carriers, cohorts and policy metadata as ordered CASE ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.text import filled
from briefloom.schema import SIGNAL_FORMATS, TOPICS

# Words that name a topic, in the order of the tags.
TOPIC_WORDS = [
    (r"\b(ai|artificial intelligence)\b", "AI"),
    (r"\bllm\b", "LLM"),
    (r"\bagent\b", "Agent"),
    (r"\brag\b", "RAG"),
    (r"\breasoning\b", "推理"),
    (r"\bopenai\b", "AI"),
    (r"\bnvidia\b", "硬件"),
    (r"\bmodel\b", "AI"),
]

# Names under which sources write a carrier.
FORMAT_ALIASES = {
    "论文": "论文", "paper": "论文", "research": "论文",
    "纯网页": "纯网页", "web": "纯网页", "company blog": "纯网页", "tech news": "纯网页", "media": "纯网页", "report": "纯网页", "product": "纯网页", "policy": "纯网页",
    "视频": "视频", "video": "视频", "社交媒体": "社交媒体", "social": "社交媒体", "公众号": "公众号", "wechat": "公众号",
    "播客": "播客", "podcast": "播客", "github热榜": "Github热榜", "github": "Github热榜", "github-trending": "Github热榜", "其他": "其他", "other": "其他",
}
ENTITY_FORMATS = {"paper": "论文", "wechat": "公众号", "video": "视频", "social": "社交媒体", "github": "Github热榜"}
PAPER_IDS = ("openreview", "hf-papers-trending", "papers-with-code-trending", "papers-with-code-sota", "papers-with-code-api", "semantic-scholar", "jmlr", "nature-machine-intelligence", "nature-computational-science", "google-scholar", "conference-authors", "arxiv-comments")
BOARD_IDS = ("chatbot-arena", "artificial-analysis", "papers-with-code-sota")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def mapped(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def infer_topics(title: Column, summary: Column, words: tuple[tuple[str, str], ...] | None = None) -> Column:
    """The first five different tags whose words occur; ``words`` are pairs of a pattern and its tag, by default the stored ones."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    tags = F.array(*[F.when(text.rlike(pattern), F.lit(tag)) for pattern, tag in words or TOPIC_WORDS])
    return F.slice(F.array_distinct(F.array_compact(tags)), 1, 5)


def normalize_topics(topics: Column, edge: Column, policy: Column) -> Column:
    """Known topics without repeats; 端侧 and 监管 are forced where they apply and are the last to go beyond four."""
    known = F.array_distinct(F.filter(F.coalesce(topics, F.array().cast("array<string>")), lambda t: t.isin(*TOPICS)))
    for holds, tag in ((edge, "端侧"), (policy, "监管")):
        forced = F.concat(F.array_remove(known, "其他"), F.array(F.lit(tag)))
        known = F.when(holds & ~F.array_contains(known, tag), forced).otherwise(known)
    pinned = F.filter(F.array(F.lit("端侧"), F.lit("监管")), lambda t: F.array_contains(known, t))
    rest = F.filter(known, lambda t: ~F.array_contains(pinned, t))
    short = F.concat(F.slice(rest, F.lit(1), F.lit(4) - F.size(pinned)), pinned)
    out = F.when(F.size(known) > 4, short).otherwise(known)
    return F.when(F.size(out) == 0, F.array(F.lit("其他"))).otherwise(out)


def known_format(raw: Column) -> Column:
    """The standard carrier that a cell names, the cell itself for other names, null for blank ones."""
    text = filled(F.trim(raw))
    return F.coalesce(mapped(F.lower(text), FORMAT_ALIASES), text)


def signal_format(source_id: Column, endpoint: Column, method: Column, entity: Column, explicit: Column) -> Column:
    """Explicit carrier, then the typed configuration's entity, then marks in the id and the address."""
    named = known_format(explicit)
    sid, url = F.lower(F.trim(F.coalesce(source_id, F.lit("")))), F.lower(F.coalesce(endpoint, F.lit("")))
    method = F.coalesce(method, F.lit(""))
    return (
        F.when(named.isin(*SIGNAL_FORMATS), named)
        .when(mapped(entity, ENTITY_FORMATS).isNotNull(), mapped(entity, ENTITY_FORMATS))
        .when((method == "Social") | (sid == "social-media") | any_of(url, ("x.com/", "twitter.com/", "weibo.com/", "linkedin.com/", "xiaohongshu.com")), "社交媒体")
        .when((method == "Bridge") | any_of(sid, ("wechat", "weixin", "公众号")) | F.contains(url, F.lit("mp.weixin.qq.com")), "公众号")
        .when(sid.startswith("arxiv-") | sid.isin(*PAPER_IDS) | any_of(url, ("arxiv.org", "openreview.net", "doi.org", "jmlr.org", "nature.com/", "aclanthology.org")), "论文")
        .when(sid.startswith("github") | F.contains(url, F.lit("github.com")), "Github热榜")
        .when((sid == "video-channels") | any_of(url, ("youtube.com", "youtu.be", "bilibili.com", "vimeo.com")), "视频")
        .when(any_of(sid, ("podcast", "播客")) | any_of(url, ("spotify.com", "xiaoyuzhoufm.com")), "播客")
        .when((sid != "") | (url != ""), "纯网页")
        .otherwise("其他")
    )


def content_type(source: Column, source_type: Column, url: Column) -> Column:
    """What a reader sees as the carrier."""
    kind = F.coalesce(source_type, F.lit(""))
    text = F.lower(F.concat_ws(" ", F.coalesce(source, F.lit("")), kind, F.coalesce(url, F.lit(""))))
    return (
        F.when(kind.isin("论文", "视频", "公众号", "播客", "Github热榜"), kind)
        .when(kind.isin("社交媒体", "Social"), "社交媒体帖子")
        .when(F.lower(kind).isin("github", "github-trending") | F.contains(text, F.lit("github.com")), "Github热榜")
        .when(any_of(text, ("mp.weixin.qq.com", "weixin.qq.com", "微信公众号", "公众号")), "公众号")
        .when(any_of(text, ("youtube.com", "youtu.be", "bilibili.com", "vimeo.com", "视频")), "视频")
        .when(any_of(text, ("arxiv.org", "openreview.net", "doi.org", "学术论文", "论文")), "论文")
        .when((F.lower(kind) == "social") | any_of(text, ("x.com/", "twitter.com/", "weibo.com/", "linkedin.com/", "社交媒体")), "社交媒体帖子")
        .otherwise("文章")
    )


def cohort(source_id: Column, category: Column, url: Column) -> Column:
    """The diagnostic group of a source."""
    sid, cat = F.lower(F.coalesce(source_id, F.lit(""))), F.coalesce(category, F.lit(""))
    return (
        F.when(sid.isin(*BOARD_IDS) | any_of(sid, ("arena", "helm", "swe-bench", "livecodebench", "aider", "opencompass", "scale-seal")), "榜单")
        .when(F.contains(sid, F.lit("career")) | F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("/careers")), "招聘")
        .when(sid.isin(*PAPER_IDS) | any_of(sid, ("hf-papers", "papers-with-code", "scholar", "openreview", "conference")), "论文站")
        .when(sid.startswith("lab-") | ((cat == "技术研究开源") & F.contains(sid, F.lit("lab"))), "实验室")
        .when((cat == "前沿模型公司") | any_of(sid, ("-blog", "-news", "anthropic", "mistral", "cohere", "meta-ai", "xai-", "bytedance", "qwen")), "公司博客")
        .when(cat == "技术研究开源", "实验室")
        .otherwise("其它")
    )


def policy_stage(title: Column, url: Column, tags: Column, with_documents: Column) -> Column:
    """The stage of an official publication, so that a report does not pass for an order."""
    name, marks = F.lower(title), F.lower(F.coalesce(tags, F.lit("")))
    action = F.contains(F.lower(url), F.lit("/presidential-actions/"))
    has = lambda text, word: F.contains(text, F.lit(word))
    return (
        F.when(action & has(name, "presidential determination"), "总统决定")
        .when(action & (has(marks, "presidential memoranda") | has(name, "presidential memorandum")), "总统备忘录")
        .when(action & (has(marks, "proclamations") | has(name, "proclamation")), "总统公告")
        .when(action & (has(marks, "executive orders") | has(name, "executive order")), "行政命令")
        .when(has(name, "fact sheet"), "事实清单")
        .when(with_documents & (has(name, "report") | has(name, "recommendations") | has(title, "报告")), "政策报告")
        .when(action, "总统行动")
        .otherwise("官方发布")
    )


def normalize_status(raw: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(text.isin("active", "已接入", "启用"), "active").when(text.isin("paused", "暂停", "停用"), "paused").otherwise("experimental")


def normalize_priority(raw: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(text.isin("P0", "P1", "P2"), text).when(text == "高", "P0").when(text == "中", "P1").otherwise("P2")
