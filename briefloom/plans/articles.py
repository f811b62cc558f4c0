"""Queries over bodies of articles, media, typed configurations and stored analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import article
from briefloom.operators import configs, media
from briefloom.plans.registry import query
from briefloom.plans.views import ENTRIES, NOW_MS, SOURCES, START_MS, entries, sources_dim, table

# The test documents have one line a paragraph; bodies have an empty line between two.
PARAGRAPHS = r"""parts AS (
  SELECT doc_id, title, para, i, regexp_replace(para, '^\s+|\s+$', '', 'g') AS line, lower(regexp_replace(para, '[^\pL\pN_]+', '', 'g')) AS letters
  FROM (SELECT doc_id, lower(regexp_replace(split_part(text, chr(10), 1), '[^\pL\pN_]+', '', 'g')) AS title,
    unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"""


def _bodies(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))


@query("lead_paragraphs", rf"""WITH {PARAGRAPHS}, tested AS (
  SELECT *, regexp_matches(line, '{article.DATE_LINE}') AS dated, line = '' OR (title <> '' AND (contains(title, letters) OR (contains(letters, title) AND length(letters) <= length(title) * 1.6)))
    OR regexp_matches(line, '{article.DATE_LINE}') OR regexp_matches(line, '{article.LEAD_LINE}') OR (length(line) < 45 AND NOT regexp_matches(line, '{article.SENTENCE_END}')) AS leads FROM parts
), begun AS (SELECT *, min(CASE WHEN NOT leads THEN i END) OVER (PARTITION BY doc_id) AS start FROM tested)
SELECT doc_id, md5(regexp_replace(coalesce(nullif(regexp_replace(string_agg(para, chr(10) || chr(10) ORDER BY i) FILTER (i >= start AND (i - start > 2 OR NOT dated)), '^\s+|\s+$', '', 'g'), ''),
  string_agg(para, chr(10) || chr(10) ORDER BY i)), '^\s+|\s+$', '', 'g')) AS body FROM begun GROUP BY doc_id""")
def lead_paragraphs(spark, d):
    return _bodies(spark, d).select("doc_id", F.md5(article.drop_leading(F.col("body"), F.col("title")).cast("binary")).alias("body"))


@query("label_paragraphs", rf"""WITH {PARAGRAPHS}, plain AS (
  SELECT doc_id, line, i FROM parts WHERE line <> '' AND NOT (regexp_matches(line, '{article.LABEL_LINE}') AND (length(line) < 40 OR NOT regexp_matches(line, '{article.SENTENCE_END}')))
), once AS (SELECT * FROM plain QUALIFY line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY i)
), tested AS (
  SELECT *, NOT regexp_matches(line, '{article.SENTENCE_END}') AS open_end, string_split_regex(line, '\s+') AS words FROM once
), ended AS (
  SELECT doc_id, line, i, max(CASE WHEN NOT ((regexp_matches(line, '{article.RIGHTS_LINE}') AND length(line) < 60) OR (length(line) <= 30 AND open_end)
    OR (length(line) <= 80 AND open_end AND NOT regexp_matches(line, '[,，]') AND len(words) >= 3 AND len(list_filter(words, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= len(words) * 0.7)) THEN i END) OVER (PARTITION BY doc_id) AS last FROM tested)
SELECT d.doc_id, md5(coalesce(string_agg(e.line, chr(10) || chr(10) ORDER BY e.i), '')) AS body
FROM documents d LEFT JOIN ended e ON e.doc_id = d.doc_id AND e.i <= e.last WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def label_paragraphs(spark, d):
    return _bodies(spark, d).select("doc_id", F.md5(article.drop_labels(F.col("body")).cast("binary")).alias("body"))


@query("meta_cover", rf"""SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_matches(u, '(?i)^https?://') AND NOT regexp_matches(u, '(?i)logo|icon|pixel|sprite|1x1') AND NOT regexp_matches(u, '{article.COVER_NOISE}') THEN u ELSE '' END AS cover
FROM (SELECT page_id, regexp_extract(url, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1) || '/i/' || page_id || '.png?a=1&b=2' AS u FROM pages)""")
def meta_cover(spark, d):
    """Pages with a cover written in front of them: a picture, a drawing that does not count, or an author's portrait."""
    tail = F.when(F.col("page_id") % 3 == 0, ".png?a=1&amp;b=2").when(F.col("page_id") % 3 == 1, ".svg").otherwise("/avatar.png")
    tag = F.concat(F.lit("<META content='/i/"), F.col("page_id").cast("string"), tail, F.lit("' property=\"og:image\">"))
    return table(spark, d, "pages").select("page_id", article.meta_cover(F.concat(tag, "html"), F.col("url")).alias("cover"))


@query("display_body", "SELECT doc_id, CASE WHEN lang = 'en' THEN left(text, 500) ELSE text END AS body, lang = 'en' AND length(text) > CASE WHEN doc_id % 2000 = 0 THEN 3000 ELSE doc_id % 2000 END AS truncated FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def display_body(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    shown = article.display_body(F.col("text"), F.when(F.col("lang") == "en", F.left("text", F.lit(500))), F.col("doc_id") % 2000)
    return docs.select("doc_id", shown["body"].alias("body"), shown["truncated"].alias("truncated"))


@query("join_hyphens", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', '-' || chr(10)),
  '([\pL\pM\pN_])-\n([\pL\pM\pN_])', '\1\2', 'g'), '([\pL\pM\pN_])-\n([\pL\pM\pN_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body FROM documents WHERE text IS NOT NULL""")
def join_hyphens(spark, d):
    """Every blank of the texts becomes a division of words, so that words on both sides of it join."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(article.join_hyphens(F.replace("text", F.lit(" "), F.lit("-\n"))).cast("binary")).alias("body"))


@query("clean_bodies")
def clean_bodies(spark, d):
    return entries(spark, d).select("doc_id", article.clean_body(F.col("body"), F.col("source_id")).alias("body"))


@query("compact_bodies")
def compact_bodies(spark, d):
    """Documents with each line as a section's heading and its text, within the budget."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", article.compact_sections(F.regexp_replace("text", r"(?m)^(\S.{1,60}?) ", "## $1\n")).alias("body"))


@query("typed_items", f"WITH {ENTRIES}, {SOURCES} SELECT doc_id, entity_type, NOT (doc_id % 2 = 0 AND length(body) < coalesce(least, 0)) AS long_enough FROM entries LEFT JOIN (SELECT source_id, CASE n % 2 WHEN 0 THEN 'paper' ELSE 'video' END AS entity_type, n * 100 AS least FROM sources_dim WHERE n % 3 > 0) USING (source_id)")
def typed_items(spark, d):
    """Items beside the typed configuration of their source, with the length test that follows the fetch of whole texts."""
    typed = sources_dim(spark).where("n % 3 > 0").select("source_id", F.when(F.col("n") % 2 == 0, "paper").otherwise("video").alias("entity_type"), (F.col("n") * 100).alias("least"))
    joined = configs.with_config(entries(spark, d), typed)
    return joined.select("doc_id", "entity_type", configs.long_enough(F.col("body"), F.col("doc_id") % 2 == 0, F.col("least")).alias("long_enough"))


@query("prepared_feeds", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '论文' WHEN page_id % 3 = 1 THEN '视频' ELSE 'as listed' END AS source_type, '其它' AS cohort FROM pages")
def prepared_feeds(spark, d):
    """Every page as a feed of its own, two thirds of them with a typed configuration."""
    sid = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    pages = table(spark, d, "pages")
    feeds = pages.select("page_id", sid.alias("source_id"), F.lit("https://e.org/").alias("url"), F.lit(None).cast("string").alias("category"), F.when(F.col("page_id") % 3 == 2, "as listed").alias("source_type"))
    typed = pages.where("page_id % 3 < 2").select(sid.alias("source_id"), F.when(F.col("page_id") % 3 == 0, "paper").otherwise("video").alias("entity_type"))
    return configs.prepared_feeds(feeds, typed).select("page_id", "source_type", "cohort")


@query("format_refresh", f"WITH {ENTRIES}, s AS (SELECT content_type AS was, CASE WHEN priority = 'P0' THEN '论文' ELSE content_type END AS now FROM entries) SELECT value, sum(b)::BIGINT AS before, sum(a)::BIGINT AS after, sum(c)::BIGINT AS changed FROM (SELECT was AS value, 1 AS b, 0 AS a, 0 AS c FROM s UNION ALL SELECT now, 0, 1, CAST(now <> was AS INT) FROM s) GROUP BY 1")
def format_refresh(spark, d):
    rows = configs.refreshed(entries(spark, d), "content_type", F.when(F.col("priority") == "P0", "论文").otherwise(F.col("content_type")))
    return configs.refresh_counts(rows, "content_type")


@query("analysis_cache", "SELECT d.doc_id, l.doc_id IS NOT NULL AND l.quality = 1 AND (l.toxic = 0 OR d.doc_id % 3 >= 2) AS cached, CASE WHEN l.quality = 1 AND (l.toxic = 0 OR d.doc_id % 3 >= 2) THEN 'stored' ELSE 'made' END AS analysis FROM documents d LEFT JOIN labels l USING (doc_id)")
def analysis_cache(spark, d):
    """Documents with the stored analysis of their labels, where good quality counts as done and toxic ones are papers of some version."""
    labels = table(spark, d, "labels")
    version = F.format_string('{"llm": {"analysis_version": %d}}', (F.col("doc_id") % 3).cast("int"))
    valid = configs.analysis_valid(F.when(F.col("quality") == 1, "已分析"), F.lit("s"), F.when(F.col("toxic") == 1, "论文").otherwise("文章"), version)
    cache = labels.select("doc_id", F.lit("stored").alias("analysis"), valid.alias("valid"))
    found = configs.with_cached(table(spark, d, "documents").select("doc_id"), cache, "doc_id", F.col("valid"), lambda rest: rest.select("doc_id", F.lit("made").alias("analysis"), F.lit(False).alias("valid")))
    return found.select("doc_id", "cached", "analysis")


@query("top_comments", "SELECT conv_id, turn, CAST(nth AS INT) AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS nth FROM conversations) WHERE nth <= 5")
def top_comments(spark, d):
    return media.top_comments(table(spark, d, "conversations"), "conv_id", F.length("text"), ["turn"]).select("conv_id", "turn", "rank")


@query("channel_videos", "SELECT l_orderkey AS channel_id, l_partkey AS video_id, l_linenumber AS place FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 10 > 0 AND (NOT (p_size BETWEEN 1 AND 19) OR l_orderkey % 2 = 0) AND (p_partkey % 4 > 0 OR l_orderkey % 3 = 0)")
def channel_videos(spark, d):
    """Lines of orders as a channel's playlist of parts; sizes are thirds of lengths, some parts are not public or live."""
    playlist = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("channel_id"), F.col("l_partkey").alias("video_id"), F.col("l_linenumber").alias("place"))
    part = F.col("p_partkey")
    details = table(spark, d, "part").select(part.alias("video_id"), F.when(part % 10 > 0, "public").otherwise("private").alias("privacy"), (F.col("p_size") * 3).alias("seconds"), F.when(part % 4 == 0, "live").alias("live"))
    key = F.col("o_orderkey")
    channels = table(spark, d, "orders").select(key.alias("channel_id"), (key % 2 == 0).alias("include_shorts"), (key % 3 == 0).alias("include_live"))
    return media.channel_videos(playlist, details, channels).select("channel_id", "video_id", "place")


@query("thread_media", """WITH k AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_at FROM lineitem GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(l_partkey || '=' || p_name, ',' ORDER BY first_at, CAST(l_partkey AS VARCHAR)) FILTER (p_size % 2 = 0), '') AS images, coalesce(string_agg(l_partkey || '=' || coalesce(p_name, ''), ',' ORDER BY first_at, CAST(l_partkey AS VARCHAR)) FILTER (p_size IS NULL OR p_size % 2 = 1), '') AS videos
FROM k LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def thread_media(spark, d):
    """Orders as threads whose lines name one medium each."""
    posts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_partkey").cast("string")).alias("media_keys"))
    known = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("media_key"), F.when(F.col("p_size") % 2 == 0, "photo").otherwise("video").alias("type"), F.col("p_name").alias("url"))
    shown = lambda name: F.array_join(F.transform(name, lambda a: F.concat(a["id"], F.lit("="), a["url"])), ",").alias(name)
    return media.thread_media(posts, known, "l_orderkey", "l_linenumber").select("l_orderkey", shown("images"), shown("videos"))


@query("merged_papers", "SELECT CAST(user_id AS VARCHAR) AS paper, max_by(event_type, event_id) FILTER (event_id % 3 > 0) AS title, min_by(CAST(event_id AS VARCHAR), event_id) FILTER (event_id % 4 = 1) AS published, max(value) AS upvotes, min(event_id) AS place FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def merged_papers(spark, d):
    at = F.col("event_id")
    mentions = table(spark, d, "events").select(F.col("user_id").cast("string").alias("paper"), at.alias("place"), F.when(at % 3 > 0, F.col("event_type")).otherwise("").alias("title"), F.when(at % 4 == 1, at.cast("string")).otherwise("").alias("published"), F.col("value").alias("upvotes"))
    return media.merged_papers(mentions)


@query("transcript_index", "SELECT key, arg_max(page_id, page_id) AS page_id FROM (SELECT page_id, unnest([CAST(page_id // 2 AS VARCHAR), trim(url), '']) AS key FROM pages) WHERE key <> '' GROUP BY 1")
def transcript_index(spark, d):
    """Pages as episodes that share guids in pairs; each has one transcript, named by its number."""
    one = F.array(F.struct(F.col("page_id").cast("string").alias("url")))
    episodes = table(spark, d, "pages").select(F.floor(F.col("page_id") / 2).cast("string").alias("guid"), F.col("url").alias("link"), F.lit("").alias("title"), F.col("page_id").alias("place"), one.alias("transcripts"))
    return media.transcript_index(episodes).select("key", F.col("transcripts")[0]["url"].cast("long").alias("page_id"))


@query("trending_papers", f"""WITH {ENTRIES}, e AS (
  SELECT source_id AS page, doc_id, CASE WHEN doc_id % 2 = 0 THEN '2401.' ELSE '2312.' END || lpad(CAST(doc_id % 700 AS VARCHAR), 5, '0') AS paper, published_ms, (doc_id % 130)::DOUBLE AS upvotes, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source_id) AS n FROM entries
), m AS (
  SELECT page, paper, i AS place, CASE WHEN doc_id % 3 > 0 THEN 'Paper ' || doc_id || ' & "co"' END AS title, CASE WHEN doc_id % 5 > 0 THEN published_ms END AS published, upvotes FROM e
  UNION ALL SELECT page, paper, n + i, CASE WHEN doc_id % 8 = 0 THEN 'linked ' || doc_id END, NULL, 0 FROM e WHERE doc_id % 4 = 0
), g AS (
  SELECT page, paper, arg_max(title, place) FILTER (title IS NOT NULL) AS title, arg_min(published, place) FILTER (published IS NOT NULL) AS listed, max(upvotes) AS upvotes, min(place) AS place FROM m GROUP BY page, paper
), f AS (
  SELECT *, CASE WHEN paper LIKE '2312%' THEN least(listed, {START_MS} - 1) ELSE listed END AS first FROM g WHERE listed IS NOT NULL
), k AS (SELECT *, ({NOW_MS} - first) / 86400000.0 AS age FROM f)
SELECT page, paper, coalesce(title, paper) AS title, strftime(make_timestamp(CAST(first // 1000 * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS published_raw, age > 7 AS heat_keep, upvotes, CAST(row_number() OVER (PARTITION BY page ORDER BY place) AS INT) AS nth
FROM k WHERE (age <= 7 AND NOT (upvotes > 0 AND upvotes < 5)) OR (age > 7 AND age <= 30 AND upvotes >= 100) QUALIFY nth <= 8""")
def trending_papers(spark, d):
    """Sources as pages that list their entries as papers in an attribute, escaped, and link to some of them below."""
    n = F.col("doc_id")
    paper = F.concat(F.when(n % 2 == 0, "2401.").otherwise("2312."), F.lpad((n % 700).cast("string"), 5, "0"))
    day = F.when(n % 5 > 0, F.date_format(F.timestamp_millis("published_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    title = F.when(n % 3 > 0, F.concat(F.lit("Paper "), n.cast("string"), F.lit(' & "co"')))
    entry = F.to_json(F.struct(title.alias("title"), F.struct(paper.alias("id"), (n % 130).alias("upvotes"), day.alias("publishedAt")).alias("paper")))
    link = F.when(n % 4 == 0, F.concat(F.lit("["), F.when(n % 8 == 0, F.concat(F.lit("linked "), n.cast("string"))).otherwise("Docs"), F.lit("](https://huggingface.co/papers/"), paper, F.lit("v2)")))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry"), link.alias("link"))))
    listed = F.concat(F.lit('{"dailyPapers": ['), F.array_join(F.transform(rows, lambda r: r["entry"]), ","), F.lit("]}"))
    escaped = F.replace(F.replace(listed, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    links = F.array_join(F.transform(rows, lambda r: r["link"]), " ")
    html = F.concat(F.lit('<div data-target="DailyPapers" data-props="'), escaped, F.lit('"></div>'), links)
    pages = entries(spark, d).groupBy(F.col("source_id").alias("page")).agg(html.alias("html"))
    return media.trending_papers(pages, "page", "html", NOW_MS).select("page", "paper", "title", "published_raw", "heat_keep", "upvotes", "nth")
