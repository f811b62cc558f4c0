"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import cells, classify, dates, html, readme, scoring, similarity, text, url
from briefloom.plans.registry import query
from briefloom.plans.views import ENTRIES, NOW_MS, entries, table

NORMAL_URL = r"lower(regexp_replace(regexp_replace(regexp_replace(split_part(trim(url), '#', 1), '([?&])(utm_[^=&]*|ref)=[^&]*', '\1', 'gi'), '[?&]+$', ''), '/+$', ''))"


@query("url_normalize", f"SELECT page_id, {NORMAL_URL} AS url FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", url.normalize_url(F.col("url")).alias("url"))


@query("url_host_path", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][\w+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages")
def url_host_path(spark, d):
    return table(spark, d, "pages").select("page_id", url.host(F.col("url")).alias("host"), url.path(F.col("url")).alias("path"))


@query("url_path_rules", r"SELECT page_id, (NOT regexp_matches(p, '/tag/|/login') AND regexp_matches(p, '(?:/en/)|(?:/de/)')) AS allowed, (len(list_filter(string_split(p, '/'), lambda s: s <> '')) >= 2 OR regexp_matches(p, '[0-9]')) AS deep FROM (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')) AS p FROM pages)")
def url_path_rules(spark, d):
    where = url.path(F.col("url"))
    return table(spark, d, "pages").select("page_id", url.path_allowed(where, ["/en/", "/de/"], ["/tag/", "/login"]).alias("allowed"), url.depth_ok(where).alias("deep"))


@query("title_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def title_strip(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


# Tags by words that the test tables have.
WORDS = ((r"(^|[^a-z0-9_])(the|of)([^a-z0-9_]|$)", "AI"), (r"(^|[^a-z0-9_])(and|und)([^a-z0-9_]|$)", "LLM"), ("tion", "RAG"), (r"(^|[^a-z0-9_])de([^a-z0-9_]|$)", "AI"), ("ment", "推理"), ("ble", "开源"), ("que", "产品"))


@query("topics_infer", f"""WITH {ENTRIES} SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(tags, range(len(tags))), lambda x: x[1] IS NOT NULL AND list_position(tags, x[1]) = x[2] + 1), lambda x: x[1])[1:5], '|') AS topics FROM (
  SELECT doc_id, [{", ".join(f"CASE WHEN regexp_matches(t, '{pattern}') THEN '{tag}' END" for pattern, tag in WORDS)}] AS tags
  FROM (SELECT doc_id, lower(title || ' ' || coalesce(body[1:400], '')) AS t FROM entries))""")
def topics_infer(spark, d):
    """The tagging operator with words of the test language, over titles and the first 400 characters as summaries."""
    topics = classify.infer_topics(F.col("title"), F.left("body", F.lit(400)), WORDS)
    return entries(spark, d).select("doc_id", F.array_join(topics, "|").alias("topics"))


@query("topics_normalize", f"""WITH {ENTRIES} SELECT doc_id, CASE
  WHEN tier = 'L1' AND priority = 'P0' THEN 'AI|LLM|端侧|监管' WHEN tier = 'L1' THEN 'AI|LLM|Agent|端侧' WHEN priority = 'P0' THEN 'AI|LLM|Agent|监管' ELSE 'AI|LLM|Agent|其他' END AS topics FROM entries""")
def topics_normalize(spark, d):
    raw = F.array(*map(F.lit, ("AI", "LLM", "none", "Agent", "AI", "其他")))
    out = classify.normalize_topics(raw, F.col("tier") == "L1", F.col("priority") == "P0")
    return entries(spark, d).select("doc_id", F.array_join(out, "|").alias("topics"))


@query("dedup_key", f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'podcast:g' || CAST(page_id AS VARCHAR) WHEN page_id % 4 = 1 THEN 'x:' || CAST(page_id AS VARCHAR) WHEN page_id % 4 = 2 THEN 'release:' || lower('Title ' || CAST(page_id AS VARCHAR)) ELSE {NORMAL_URL} END AS key FROM pages")
def dedup_key(spark, d):
    pages = table(spark, d, "pages")
    number, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    method = F.when(kind == 0, "Podcast").when(kind == 1, "Social").otherwise("RSS")
    key = url.dedup_key(url.normalize_url(F.col("url")), F.concat(F.lit("Title "), number), method, F.when(kind == 2, "hash(model+version)").otherwise(""), F.when(kind == 0, F.concat(F.lit("g"), number)), F.when(kind == 1, number))
    return pages.select("page_id", key.alias("key"))


@query("arxiv_first_published", "SELECT doc_id, CASE WHEN CAST(doc_id % 15 AS INT) BETWEEN 1 AND 12 THEN least(1706659200000, epoch_ms(CAST(last_day(make_date(2020 + CAST(doc_id % 5 AS INT), CAST(doc_id % 15 AS INT), 1)) AS TIMESTAMP) + INTERVAL 1 DAY) - 1) ELSE 1706659200000 END AS first_ms FROM documents")
def arxiv_first_published(spark, d):
    paper = F.format_string("%02d%02d.%05d", (F.col("doc_id") % 5 + 20).cast("int"), (F.col("doc_id") % 15).cast("int"), F.col("doc_id").cast("int"))
    return table(spark, d, "documents").select("doc_id", url.first_published_ms(url.arxiv_id(F.concat(F.lit("https://arxiv.org/abs/"), paper, F.lit("v2"))), F.lit(NOW_MS)).alias("first_ms"))


@query("lookback_parse", "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN 24 WHEN 1 THEN 72 WHEN 2 THEN 24 WHEN 3 THEN 168 WHEN 4 THEN 0 ELSE 168 END AS INT) AS hours FROM documents")
def lookback_parse(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("24h", "3 d", "每日", "每周", "0.5h", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", dates.lookback_hours(raw).alias("hours"))


@query("duration_parse", "SELECT doc_id, CAST(doc_id % 86400 AS INT) AS clock, CAST(doc_id % 86400 AS INT) AS iso, CAST(0 AS INT) AS bad, CAST(doc_id % 60 AS INT) AS plain FROM documents")
def duration_parse(spark, d):
    seconds = (F.col("doc_id") % 86400).cast("int")
    label = dates.clock_label(seconds)
    iso = F.format_string("PT%dH%dM%dS", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), seconds % 60)
    return table(spark, d, "documents").select("doc_id", dates.clock_seconds(label).alias("clock"), dates.iso_seconds(iso).alias("iso"), dates.iso_seconds(F.lit("1 hour")).alias("bad"), dates.clock_seconds((seconds % 60).cast("string")).alias("plain"))


@query("cn_day", f"WITH {ENTRIES} SELECT doc_id, strftime(make_timestamp((published_ms + 28800000) * 1000), '%Y-%m-%d') AS day FROM entries")
def cn_day(spark, d):
    return entries(spark, d).select("doc_id", dates.cn_day(F.col("published_ms")).alias("day"))


@query("date_parse", f"WITH {ENTRIES} SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE published_ms // 1000 * 1000 END AS ms FROM entries")
def date_parse(spark, d):
    stamp = F.timestamp_millis(F.col("published_ms"))
    forms = [F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.date_format(stamp, "EEE, d MMM yyyy HH:mm:ss 'GMT'"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("2031-01-01")]
    raw = F.element_at(F.array(*forms), (F.col("doc_id") % 5 + 1).cast("int"))
    return entries(spark, d).select("doc_id", dates.parse_date_ms(raw, NOW_MS).alias("ms"))


@query("cjk_ratio", "SELECT doc_id, round(CAST(least(doc_id % 7, 5) AS DOUBLE) / (least(doc_id % 7, 5) + 5), 6) AS ratio, CAST(least(doc_id % 7, 5) AS DOUBLE) / (least(doc_id % 7, 5) + 5) >= 0.15 AS chinese FROM documents")
def cjk_ratio(spark, d):
    mixed = F.concat(F.left(F.lit("智能模型发布"), F.least(F.col("doc_id") % 7, F.lit(5)).cast("int")), F.lit("model"))
    return table(spark, d, "documents").select("doc_id", F.round(text.cjk_ratio(mixed), 6).alias("ratio"), text.is_chinese(mixed).alias("chinese"))


@query("keyword_density", f"WITH {ENTRIES} SELECT doc_id, (len(regexp_extract_all(title, '(?i)ing')) > 0 OR len(regexp_extract_all(body, '(?i)ing')) >= 20) AS ok FROM entries")
def keyword_density(spark, d):
    return entries(spark, d).select("doc_id", text.keyword_ok(F.col("title"), F.col("body"), F.lit("ing"), F.lit(20)).alias("ok"))


@query("podcast_keyword", f"WITH {ENTRIES} SELECT doc_id, (len(regexp_extract_all(title, '(?i)tion')) > 0 OR len(regexp_extract_all(body[1:1600], '(?i)tion')) >= 3) AS ok FROM entries")
def podcast_keyword(spark, d):
    return entries(spark, d).select("doc_id", text.podcast_keyword_ok(F.col("title"), F.col("body"), F.lit("tion"), F.lit(1)).alias("ok"))


@query("signal_format", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '论文' WHEN page_id % 3 = 1 THEN '视频' ELSE '纯网页' END AS format FROM pages")
def signal_format(spark, d):
    kind = F.col("page_id") % 3
    explicit, entity = F.when(kind == 0, "paper"), F.when(kind == 1, "video")
    return table(spark, d, "pages").select("page_id", classify.signal_format(F.lit("some-source"), F.col("url"), F.lit("RSS"), entity, explicit).alias("format"))


@query("content_type", "SELECT doc_id, (['视频', '社交媒体帖子', 'Github热榜', '公众号', '论文', '文章'])[doc_id % 6 + 1] AS content_type FROM documents")
def content_type(spark, d):
    links = ("https://youtu.be/abc", "https://x.com/a/status/1", "https://github.com/a/b", "https://mp.weixin.qq.com/s/1", "https://arxiv.org/abs/2401.00001", "https://example.org/post")
    link = F.element_at(F.array(*map(F.lit, links)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", classify.content_type(F.lit("Source"), F.lit("RSS"), link).alias("content_type"))


@query("scrape_cohort", "SELECT doc_id, (['榜单', '招聘', '论文站', '实验室', '公司博客', '其它'])[doc_id % 6 + 1] AS cohort FROM documents")
def scrape_cohort(spark, d):
    names = ("chatbot-arena", "acme-careers", "hf-papers-x", "lab-one", "acme-blog", "src")
    return table(spark, d, "documents").select("doc_id", classify.cohort(F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(""), F.lit("")).alias("cohort"))


@query("policy_stage", "SELECT doc_id, (['行政命令', '总统备忘录', '事实清单', '总统行动', '官方发布'])[doc_id % 5 + 1] AS stage FROM documents")
def policy_stage(spark, d):
    at = (F.col("doc_id") % 5 + 1).cast("int")
    title = F.element_at(F.array(*map(F.lit, ("An Executive Order on X", "Presidential Memorandum", "Fact Sheet: Y", "A Message", "Report"))), at)
    link = F.when(at.isin(1, 2, 4), "https://w.gov/presidential-actions/1").otherwise("https://w.gov/news/1")
    return table(spark, d, "documents").select("doc_id", classify.policy_stage(title, link, F.lit(""), F.lit(False)).alias("stage"))


@query("paper_signal_score", f"""WITH {ENTRIES}, p AS (SELECT doc_id, title || ' benchmark reasoning' || CASE WHEN doc_id % 3 = 0 THEN ' withdrawn' ELSE '' END AS t, body FROM entries)
SELECT doc_id, CAST(greatest(0, least(100, 50 + 15 + CASE WHEN length(body) >= 800 THEN 5 WHEN length(body) < 200 THEN -10 ELSE 0 END + 8 + 8 + CASE WHEN doc_id % 3 = 0 THEN -50 ELSE 0 END)) AS INT) AS score FROM p""")
def paper_signal_score(spark, d):
    title = F.concat("title", F.lit(" benchmark reasoning"), F.when(F.col("doc_id") % 3 == 0, " withdrawn").otherwise(""))
    return entries(spark, d).select("doc_id", scoring.paper_signal(title, F.col("body"), F.lit("https://github.com/a/b")).alias("score"))


@query("quality_score", f"""WITH {ENTRIES}, s AS (SELECT doc_id, CAST(doc_id % 101 AS DOUBLE) AS venue, quality AS signal, CAST(length(body) % 600 AS DOUBLE) AS up, CAST(account % 90 AS DOUBLE) AS cm FROM entries),
h AS (SELECT *, CASE WHEN up <= 0 THEN 0 ELSE least(100, 100 * ln(1 + up) / ln(501)) END AS lu, CASE WHEN cm <= 0 THEN 0 ELSE least(100, 100 * ln(1 + cm) / ln(81)) END AS lc FROM s),
r AS (SELECT *, round_even(least(100, 0.6::DOUBLE * lu + 0.4::DOUBLE * lc), 1) AS heat FROM h)
SELECT doc_id, heat, CASE WHEN doc_id % 4 > 0 THEN 0.40::DOUBLE * venue + 0.35::DOUBLE * signal + 0.25::DOUBLE * heat ELSE (0.40::DOUBLE * venue + 0.35::DOUBLE * signal) / 0.75::DOUBLE END >= 50 AS high FROM r""")
def quality_score(spark, d):
    """Votes are lengths of bodies, comments are accounts; a quarter of the entries has no community data."""
    heat = scoring.community_heat((F.length("body") % 600).cast("double"), (F.col("account") % 90).cast("double"))
    rows = entries(spark, d).withColumn("heat", heat)
    whole = scoring.whole_quality((F.col("doc_id") % 101).cast("double"), F.col("heat"), F.col("quality"), F.col("doc_id") % 4 > 0)
    return rows.select("doc_id", "heat", (whole >= 50).alias("high"))


@query("venue_score", "SELECT doc_id, (['blacklisted', 'no_acceptance', 'whitelist', 'accepted_other'])[doc_id % 4 + 1] AS reason, CAST(([0, 20, 100, 60])[doc_id % 4 + 1] AS DOUBLE) AS score FROM documents")
def venue_score(spark, d):
    comment = F.element_at(F.array(*map(F.lit, ("Accepted at CHIL 2024; 9 pages", "12 pages", "To appear in NeurIPS 2024 as a poster", "accepted to ICML"))), (F.col("doc_id") % 4 + 1).cast("int"))
    out = scoring.venue_score(scoring.accepted_venue(comment, F.lit("")), F.array(F.lit("neurips")), F.array(F.lit("chil")))
    return table(spark, d, "documents").select("doc_id", out["reason"].alias("reason"), out["score"].alias("score"))


@query("prefer_score", f"""WITH {ENTRIES} SELECT source_id, max(doc_id) FILTER (r = 1) AS best FROM (SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY
  (CASE tier WHEN 'L1' THEN 40 WHEN 'L2' THEN 25 WHEN 'L4' THEN 5 ELSE 12 END) + (CASE priority WHEN 'P0' THEN 30 WHEN 'P1' THEN 18 ELSE 8 END) + (CASE content_type WHEN '论文' THEN -2 ELSE 0 END) DESC, published_ms, length(body) DESC, doc_id) AS r FROM entries) GROUP BY source_id""")
def prefer_score(spark, d):
    score = scoring.prefer(F.col("tier"), F.col("priority"), F.col("content_type"), F.col("published_ms"), F.length("body"))
    best = F.max_by("doc_id", F.struct(score, -F.col("doc_id")))
    return entries(spark, d).groupBy("source_id").agg(best.alias("best"))


@query("social_score", "SELECT doc_id, CAST(least(100, CASE doc_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 12 ELSE 6 END + CASE WHEN doc_id % 2 = 0 THEN 25 ELSE 8 END + CASE WHEN doc_id % 2 = 0 THEN 14 ELSE 0 END + 12 + least(15, greatest(0, round_even(5 * log2(1 + (doc_id % 50) / 2.0), 0)))) AS INT) AS score FROM documents")
def social_score(spark, d):
    body = F.when(F.col("doc_id") % 2 == 0, "launch https://github.com/a").otherwise("hello there")
    tier = F.concat(F.lit("P"), (F.col("doc_id") % 3).cast("string"))
    engaged = scoring.engagement_points((F.col("doc_id") % 50).cast("double"), F.lit(2.0), F.lit(0.0), F.lit(None).cast("double"))
    return table(spark, d, "documents").select("doc_id", scoring.social_score(tier, body, F.lit(False), F.lit(1), F.lit(12), engaged).alias("score"))


@query("engagement", "SELECT event_id, CAST(event_id % 7 + 2 * (event_id % 5 + event_id % 3 + 0) + event_id % 2 AS BIGINT) AS engagement FROM events")
def engagement(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", scoring.engagement(e % 7, e % 5, e % 3, F.lit(None).cast("long"), e % 2).cast("long").alias("engagement"))


@query("json_cell", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_cell(spark, d):
    return table(spark, d, "events").select("event_id", cells.json_struct(F.col("props"), "k int")["k"].alias("k"))


@query("typed_cells", "SELECT doc_id, CAST(2 AS INT) AS items, doc_id % 2 = 0 AS flag, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id AS DOUBLE) END AS number FROM documents")
def typed_cells(spark, d):
    number = F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise(F.col("doc_id").cast("string"))
    flag = F.when(F.col("doc_id") % 2 == 0, " 是 ").otherwise("no")
    return table(spark, d, "documents").select("doc_id", F.size(cells.text_list(F.lit("A，b;; "))).alias("items"), cells.boolean(flag).alias("flag"), cells.number(number).alias("number"))


@query("link_extract", """SELECT page_id, CAST(len(l) AS BIGINT) AS n, coalesce(l[1], '') AS first FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"#]+)', 1), lambda x: true) AS raw, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"#]+)', 1)) AS x, generate_subscripts(regexp_extract_all(html, '<a href="([^"#]+)', 1), 1) AS i) GROUP BY x)) AS l FROM pages)""")
def link_extract(spark, d):
    links = url.hrefs(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.coalesce(F.get(links, 0), F.lit("")).alias("first"))


@query("pdf_links", """SELECT page_id, CAST(len(list_distinct(list_filter(regexp_extract_all(html, '<a href="([^"#]+)', 1), lambda x: regexp_matches(lower(x), '[.]pdf($|[?])')))) AS BIGINT) AS n FROM pages""")
def pdf_links(spark, d):
    documents = F.filter(url.hrefs(F.col("html")), lambda u: F.lower(u).rlike(r"\.pdf($|\?)"))
    return table(spark, d, "pages").select("page_id", F.size(documents).cast("long").alias("n"))


@query("html_to_text")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_to_text("html").alias("text"))


@query("article_parse")
def article_parse(spark, d):
    return table(spark, d, "pages").select("page_id", html.article_text("html").alias("text"))


@query("readme_parse")
def readme_parse(spark, d):
    """Documents as READMEs: bars, sections by their names in the language of the tables, tables."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return readme.with_readme_text(docs, "text", "text", README_SECTIONS)


# Sections that count as boilerplate in the language of the test tables.
README_SECTIONS = "(?:the|de|in) .*"
LINK_SQL = r"\[([^\]]*)\]\([^)]*\)"


@query("readme_outline", rf"""WITH l AS (
  SELECT doc_id, i, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), p AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(s, '{LINK_SQL}', '', 'g'), '(?is)<a\b.*?</a>', '', 'g'), '<[^>]+>', '', 'g') AS rest, trim(regexp_replace(regexp_replace(s, '{LINK_SQL}', '\1', 'g'), '<[^>]+>', '', 'g')) AS plain FROM l WHERE s <> ''
), k AS (
  SELECT *, CASE WHEN length(s) > {readme.BAR_CHARS} THEN '' WHEN regexp_replace(rest, '[|·•/\\\-—–>»\s]+', '', 'g') = '' THEN 'link' WHEN starts_with(s, '|') THEN ''
    WHEN len(list_filter(string_split(plain, '|'), lambda c: trim(c) <> '')) >= {readme.LEAST_CELLS} AND len(list_filter(string_split(plain, '|'), lambda c: length(trim(c)) > {readme.CELL_CHARS})) = 0 THEN 'row'
    WHEN ends_with(plain, '|') AND length(plain) <= {readme.PIECE_CHARS} THEN 'pipe' ELSE '' END AS kind FROM p
), b AS (
  SELECT *, coalesce(lag(kind) OVER w, '') || coalesce(lead(kind) OVER w, '') AS beside FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), h AS (
  SELECT *, CASE WHEN head <> '' THEN regexp_full_match(head, '(?i)(?:{README_SECTIONS})\s*[:：]?') WHEN length(s) <= {readme.BARE_HEADING} AND regexp_full_match(s, '(?i)(?:{README_SECTIONS})\s*[:：]?') THEN true END AS skips
  FROM (SELECT *, regexp_extract(line, '^\s{{0,3}}#{{1,6}}\s+(.+?)\s*#*\s*$', 1) AS head FROM b WHERE NOT (kind IN ('link', 'row') OR (kind = 'pipe' AND beside <> '')))
), t AS (SELECT *, coalesce(last_value(skips IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), false) AS skipped FROM h)
SELECT d.doc_id, coalesce(string_agg(t.line, chr(10) ORDER BY t.i), '') AS text FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id AND NOT t.skipped WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def readme_outline(spark, d):
    """What bars and sections leave of a document's lines."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", readme.without_sections(readme.without_bars(F.col("text")), README_SECTIONS).alias("text"))


@query("split_chunks")
def split_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(html.pack_paragraphs(F.col("text"), 600)).cast("long").alias("chunks"))


@query("transcript_lines", "SELECT doc_id, CAST(2 AS BIGINT) AS n, CAST((doc_id % 60) * 60 + 5 AS BIGINT) AS last FROM documents")
def transcript_lines(spark, d):
    content = F.format_string("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nfirst <b>line</b>\n\n00:%02d:05.000 --> 00:59:59.000\nsecond\nline\n", F.col("doc_id") % 60)
    parsed = html.parse_transcript(content, F.lit("text/vtt"))
    return table(spark, d, "documents").select("doc_id", F.size(parsed).cast("long").alias("n"), F.element_at(parsed, -1)["second"].cast("long").alias("last"))


@query("title_tokens", f"""WITH {ENTRIES} SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*|[0-9]+(?:[.][0-9]+)*'), lambda w: NOT list_contains({list(similarity.STOP_WORDS)!r}, w) AND (length(w) >= 3 OR regexp_matches(w, '[0-9]')))) AS BIGINT) AS n FROM entries""")
def title_tokens(spark, d):
    return entries(spark, d).select("doc_id", F.size(similarity.anchors(F.col("title"))).cast("long").alias("n"))


@query("bullet_title", f"WITH {ENTRIES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Given' ELSE trim(split_part(title, ';', 1))[1:28] END AS bullet FROM entries")
def bullet_title(spark, d):
    return entries(spark, d).select("doc_id", text.bullet_title(F.col("title"), F.when(F.col("doc_id") % 2 == 0, "Given").otherwise("要点 3")).alias("bullet"))


@query("repo_score", "SELECT p_partkey, round(log10(p_size + 1) + 0.5 * log10(p_partkey + 1) + CASE WHEN p_partkey % 3 = 0 THEN 1.2 ELSE 0 END - CASE WHEN p_partkey % 5 = 0 THEN 0.5 ELSE 0 END, 6) AS score FROM part")
def repo_score(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.round(scoring.repo_score(F.col("p_size"), k, k % 3 == 0, F.lit(False), F.lit(False), k % 5 == 0), 6).alias("score"))


@query("endpoint_normalize", "SELECT page_id, 'https://e.org/a%20b?' || CAST(page_id AS VARCHAR) || '#t' AS endpoint, 'https://e.org/?date=2024-01-01' AS detail FROM pages")
def endpoint_normalize(spark, d):
    raw = F.concat(F.lit(" e.org/a b?"), F.col("page_id").cast("string"), F.lit("#t"))
    return table(spark, d, "pages").select("page_id", url.endpoint(raw).alias("endpoint"), url.detail_url(F.lit("https://e.org//"), F.lit("2024-01-01")).alias("detail"))


@query("pdf_url", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://arxiv.org/pdf/2401.00001' WHEN 1 THEN 'https://e.org/x.PDF?a' ELSE '' END AS pdf FROM documents")
def pdf_url(spark, d):
    links = ("https://arxiv.org/abs/2401.00001v2", "https://e.org/x.PDF?a", "https://e.org/x")
    link = F.element_at(F.array(*map(F.lit, links)), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", url.pdf_url(link, F.lit("")).alias("pdf"))
