"""The list of repositories of a day: two routes in one pool, thresholds and points, the newest release, quotas.

A repository is news if it was made within the window, or if it released something within it. Release feeds are rows that may
be missing, so a repository is in one of three states: nothing is known of its releases (no feed, which drops it), it has
none, or it has one.

Defined cases: null counts are 0, null topics none; a repository without a name is left out; of rows of one name the first of
the established route stays, or else the first of the other; times that are null make a repository neither new nor pushed;
several feeds of one name count as the first by their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefloom.config import DAY_MS
from briefloom.functions import scoring

# Topics that a repository should have one of, topics and names that rule it out, words of its subject and of wrappers.
TOPICS = (
    "llm", "large-language-models", "llmops", "agent", "ai-agent", "ai-agents",
    "rag", "retrieval-augmented-generation", "inference", "llm-inference",
    "mlops", "transformers", "diffusion", "diffusion-models", "fine-tuning",
    "vector-database", "embeddings", "multimodal", "reasoning", "generative-ai",
    "deep-learning", "machine-learning", "nlp", "computer-vision",
    "text-to-image", "text-to-video", "model-serving", "quantization",
)
EXCLUDED_TOPICS = (
    "awesome", "awesome-list", "book", "books", "tutorial", "tutorials",
    "roadmap", "interview", "interviews", "cheatsheet", "cheat-sheet",
    "course", "courses", "learning-resources",
)
SUBJECT = (
    r"(llm|gpt|claude|gemini|llama|qwen|mistral|deepseek|agent|rag|inference|"
    r"transformer|diffusion|multimodal|fine[- ]?tun|embedding|vector|reasoning|"
    r"mlops|llmops|serving|quantiz|prompt|copilot|assistant|neural|"
    r"deep[- ]?learning|machine[- ]?learning|text-to-|speech|vision|"
    r"foundation model|generative)"
)
EXCLUDED_NAME = (
    r"(awesome|roadmap|interview|cheat-?sheet|tutorial|handbook|course|"
    r"free-?code-?camp|500-?lines|教程|面试|资料)"
)
WRAPPER = (
    r"\b(wrapper|ui for|client for|sdk for|unofficial|mirror of|clone of|"
    r"gui for|telegram bot|discord bot|chrome extension)\b"
)
# Marks of a version before its release, and the part of a feed's entry that holds what is said of it.
PRERELEASE = (
    r"(?i)(?:\d|[\s\-._])(?:rc|alpha|beta|preview|nightly|canary|snapshot|dev|pre)[\s\-._]?\d"
    r"|(?:^|[\s\-._])(?:rc|alpha|beta|preview|nightly|canary|snapshot|unstable)(?:$|[\s\-._])"
)
ENTRY_HEAD = 4000


@dataclass(frozen=True)
class RepoRules:
    """Thresholds, window and quotas; languages are a choice only where there are any."""

    now_ms: int
    most: int = 8
    least_stars: int = 2000
    least_new_stars: int = 500
    least_forks: int = 0
    least_new_forks: int = 20
    active_days: int = 90
    release_days: int = 30
    new_share: float = 0.3
    topics: tuple[str, ...] = TOPICS
    excluded_topics: tuple[str, ...] = EXCLUDED_TOPICS
    subject: str = SUBJECT
    excluded_name: str = EXCLUDED_NAME
    languages: tuple[str, ...] = ()

    @property
    def most_new(self) -> int:
        return max(1, round(self.most * self.new_share))

    @property
    def most_lookups(self) -> int:
        """Established repositories that are asked for a release."""
        return max(3 * self.most, 30)


def pool(established: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Both routes as one, a row for each name: the first row of the first route that has it."""
    rows = established.withColumn("_route", F.lit(0)).unionByName(fresh.withColumn("_route", F.lit(1)))
    firsts = rows.where(F.coalesce("full_name", F.lit("")) != "").groupBy("full_name").agg(F.min(F.struct("_route", order, *[c for c in established.columns if c not in ("full_name", order)])).alias("r"))
    return firsts.select("full_name", "r.*").withColumnRenamed("_route", "route").select(*established.columns, "route")


def scored(repos: DataFrame, rules: RepoRules) -> DataFrame:
    """Repositories above their thresholds and on the subject, with ``is_new`` and ``score``.

    Rows hold: full_name, description, topics, language, stars, forks, created_ms, pushed_ms.
    """
    stars, forks = (F.coalesce(c, F.lit(0)) for c in ("stars", "forks"))
    age = lambda c: (F.lit(rules.now_ms) - F.col(c)) / DAY_MS
    within = lambda c, days: F.coalesce(age(c) <= days, F.lit(False))
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.lower(t))
    has = lambda names: F.arrays_overlap(topics, F.array(*map(F.lit, names))) if names else F.lit(False)
    said = F.concat_ws(" ", "full_name", F.coalesce("description", F.lit("")), F.array_join(topics, " "))
    rows = repos.withColumns({"is_new": within("created_ms", rules.release_days), "on_topic": F.coalesce(has(rules.topics), F.lit(False)), "_said": said, "_out": F.coalesce(has(rules.excluded_topics), F.lit(False))})
    rows = rows.where(stars >= F.when(F.col("is_new"), rules.least_new_stars).otherwise(rules.least_stars)).where(forks >= F.when(F.col("is_new"), rules.least_new_forks).otherwise(rules.least_forks))
    rows = rows.where(~F.col("full_name").rlike(f"(?iU){rules.excluded_name}") & ~F.col("_out")).where(F.col("on_topic") | F.col("_said").rlike(f"(?iU){rules.subject}"))
    if rules.languages:
        rows = rows.where((F.coalesce("language", F.lit("")) == "") | F.lower("language").isin(*[x.lower() for x in rules.languages]))
    score = scoring.repo_score(stars, forks, F.col("is_new"), F.col("on_topic"), within("pushed_ms", rules.active_days), F.col("_said").rlike(f"(?iU){WRAPPER}"))
    return rows.withColumn("score", score).drop("_said", "_out", "on_topic")


def latest_release(feed: Column) -> Column:
    """(tag, published, link) of a feed's first entry that is no version before its release.

    Null without a feed; a struct of nulls where no entry will do. An entry needs a title and a time in what stands before its
    content.
    """
    entry = lambda e: F.left(e, F.lit(ENTRY_HEAD))
    part = lambda e, pattern: F.regexp_extract(entry(e), pattern, 1)
    tag = lambda e: F.trim(F.regexp_replace(part(e, r"(?s)<title[^>]*>(.*?)</title>"), r"(?U)\s+", " "))
    updated = lambda e: F.trim(part(e, r"<updated>([^<]+)</updated>"))
    read = lambda e: F.struct(tag(e).alias("tag"), updated(e).alias("published"), F.nullif(part(e, r"""<link[^>]*href="([^"]+)\""""), F.lit("")).alias("link"))
    entries = F.split(feed, "<entry>")
    stable = F.filter(F.transform(F.slice(entries, 2, F.size(entries)), read), lambda r: (r["tag"] != "") & (r["published"] != "") & ~r["tag"].rlike(PRERELEASE))
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("tag", "published", "link")])
    return F.when(F.coalesce(feed, F.lit("")) != "", F.coalesce(F.get(stable, F.lit(0)), none))


def repository_items(repos: DataFrame, feeds: DataFrame, rules: RepoRules, order: str) -> DataFrame:
    """The list: full_name, is_new, title, url, published, event, score, nth.

    ``repos`` are rows of ``scored``; ``feeds`` holds full_name and feed. New repositories have a quota; established ones are
    asked for a release in the order of their points, up to a number of them, and stay if it lies within the window.
    """
    by_points = [F.desc("score"), F.desc("stars"), order]
    fresh = repos.where("is_new").orderBy(*by_points).limit(rules.most_new)
    asked = repos.where("NOT is_new").orderBy(*by_points).limit(rules.most_lookups)
    known = feeds.join(asked.select("full_name"), "full_name", "left_semi").groupBy("full_name").agg(F.min("feed").alias("feed"))
    met = asked.join(known, "full_name", "left").withColumn("release", latest_release(F.col("feed")))
    released = F.unix_millis(F.try_to_timestamp(F.col("release.published")))
    news = met.where((F.lit(rules.now_ms) - released) / DAY_MS <= rules.release_days)
    home = F.concat(F.lit("https://github.com/"), F.col("full_name"))
    day = lambda c: F.left(c, F.lit(10))
    created = F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = ["full_name", "is_new", "score", "stars", order]
    new_items = fresh.select(*base, F.col("full_name").alias("title"), home.alias("url"), created.alias("published"), F.concat(F.lit("🌱 新项目｜创建于 "), day(created)).alias("event"))
    old_items = news.select(
        *base,
        F.concat_ws(" ", "full_name", "release.tag").alias("title"),
        F.coalesce("release.link", home).alias("url"),
        F.col("release.published").alias("published"),
        F.concat(F.lit("🚀 新版本 "), F.col("release.tag"), F.lit("｜发布于 "), day(F.col("release.published"))).alias("event"),
    )
    listed = new_items.unionByName(old_items).orderBy(*by_points).limit(rules.most)
    place = F.row_number().over(Window.orderBy(*by_points))  # over the list, whose length is a quota
    return listed.withColumn("nth", place).select("full_name", "is_new", F.left("title", F.lit(200)).alias("title"), "url", "published", "event", "score", "nth")
