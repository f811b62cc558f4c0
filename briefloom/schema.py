"""Types of the engine's tables and the values of its enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of content carriers, topics, stages and groups as the stored tables spell them.
FETCH_METHODS = ("RSS", "Scrape", "Bridge", "Social", "Media", "Podcast", "API", "Manual")
STATUSES = ("active", "experimental", "paused")
PRIORITIES = ("P0", "P1", "P2")
TIERS = ("L1", "L2", "L3", "L4")
SIGNAL_FORMATS = ("论文", "纯网页", "视频", "社交媒体", "公众号", "播客", "Github热榜", "其他")
CONTENT_TYPES = ("论文", "视频", "公众号", "播客", "Github热榜", "社交媒体帖子", "文章")
TOPICS = ("AI", "LLM", "Agent", "RAG", "推理", "多模态", "开源", "硬件", "端侧", "监管", "融资", "产品", "其他")
EVENT_GROUPS = ("官方来源", "相关报道", "交叉验证", "补充视角")
SEND_STATES = ("待发送", "已发送", "失败")

IMAGE = T.StructType().add("url", "string").add("alt", "string").add("kind", "string")
VIDEO = T.StructType().add("id", "string").add("platform", "string").add("url", "string").add("embedUrl", "string").add("thumbnailUrl", "string").add("durationSec", "integer").add("views", "long").add("commentCount", "long")
DOCUMENT = T.StructType().add("url", "string").add("title", "string").add("type", "string").add("pages", "integer").add("extractedChars", "integer")
MEDIA_ASSETS = T.StructType().add("images", T.ArrayType(IMAGE)).add("videos", T.ArrayType(VIDEO)).add("documents", T.ArrayType(DOCUMENT))
LINK = T.StructType().add("link", "string").add("text", "string")

FEEDS = "source_id string, name string, fetch_method string, source_type string, status string, priority string, tier string, endpoint string, lookback_hours int, keyword_regex string, keyword_min_hits int, title_exclude_regex string, min_content_chars int, dedup_key string"
RAW_ITEMS = "ord long, source_id string, title string, url string, body string, published_raw string, image_url string, heat_keep boolean, podcast_guid string, x_post_id string"
ENTRIES = "record_id string, source_id string, duplicate_key string, title string, url string, body string, published_ms long, collected_ms long, content_type string, tier string, quality double"
BRIEFS = "date string, title string, intro string, record_ids string, send_status string"
