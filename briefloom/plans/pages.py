"""Queries over pages: their pictures, dates, what entries show of them, and pages that come as markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import article, dates, markdown, pictures
from briefloom.operators.pictures import one_picture_each
from briefloom.plans.registry import query
from briefloom.plans.views import ENTRIES, NOW_MS, entries, table

LABELS = ", ".join(f"'{name}'" for name in pictures.COMMON_LABELS)


@query("image_extract", rf"""WITH names AS (
  SELECT page_id, url, unnest(found) AS name, generate_subscripts(found, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS found FROM pages)
), links AS (
  SELECT page_id, i, replace(name, '&amp;', '&') AS alt, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || '/' || replace(name, '&amp;', '&') || '.png?p=1' AS link,
    string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.') AS labels, lower(regexp_replace(regexp_extract(replace(name, '&amp;', '&') || '.png', '^[^?#]*'), '\.[^.]*$', '')) AS stem
  FROM names WHERE NOT regexp_matches(name, '^[A-Zaeiou]')
), once AS (
  SELECT page_id, min(i) AS i, arg_min(link, i) AS link FROM links
  WHERE NOT regexp_matches(link, '{pictures.NO_CONTENT}') AND NOT regexp_matches(alt, '{pictures.CHROME}') AND NOT (list_contains(labels, stem) AND stem NOT IN ({LABELS}))
  GROUP BY page_id, split_part(link, '?', 1)
), first AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth FROM once QUALIFY nth <= 4)
SELECT p.page_id, count(f.i) AS n, coalesce(string_agg(f.link, '|' ORDER BY f.i), '') AS images FROM pages p LEFT JOIN first f USING (page_id) GROUP BY 1""")
def image_extract(spark, d):
    """Pages whose links stand for pictures: small by their name, small by their width, by a set of addresses or loaded late."""
    html = F.col("html")
    for link, tag in (
        ('<a href="/([A-Z][^"]*)">', '<img data-original="/$1-150x150.png">'),
        ('<a href="/([aeiou][^"]*)">', '<img data-src="/$1.png" width="120">'),
        (r'<a href="/([b-m][^",\s]*)">', '<img alt="$1" srcset="/$1.png?p=1 800w">'),
        ('<a href="/([^"]*)">', '<img class="wide" alt="$1" data-lazy-src="/$1.png?p=1">'),
    ):
        html = F.regexp_replace(html, link, tag)
    found = pictures.pictures_of(html, F.col("url"))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda x: x["url"]), "|").alias("images"))


@query("page_dates", "SELECT page_id, CASE WHEN k < 3 THEN strftime(day, '%Y-%m-%d') || CASE WHEN k = 1 THEN 'T01:02:03Z' ELSE '' END WHEN k = 3 THEN strftime(day, '%B %-d, %Y') WHEN k = 4 THEN strftime(day, '%-d %B %Y') ELSE '' END AS published_raw, CASE WHEN k < 5 THEN epoch_ms(day) + CASE WHEN k = 1 THEN 3723000 ELSE 0 END END AS ms FROM (SELECT page_id, page_id % 6 AS k, CAST(DATE '2024-01-01' + CAST(page_id % 29 AS INT) AS TIMESTAMP) AS day FROM pages)")
def page_dates(spark, d):
    """Pages with the date of their number in one of five places that tell a first publication, beside the date of a change."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 29).cast("int"))
    iso, html, kind = F.date_format(day, "yyyy-MM-dd"), F.col("html"), F.col("page_id") % 6
    put = lambda mark, text: F.replace(html, F.lit(mark), F.concat(F.lit(mark), *[F.lit(t) if isinstance(t, str) else t for t in text]))
    page = (
        F.when(kind == 0, put("<head>", ["<meta content='", iso, "' name=\"pubdate\">"]))
        .when(kind == 1, put("</style>", [r'<script>push([1,"post\":{\"_createdAt\":\"', iso, r'T01:02:03Z\"}"])</script>']))
        .when(kind == 2, put("<article>", ['<time datetime="', iso, '">']))
        .when(kind == 3, put("</h1>", ["<div>", F.date_format(day, "MMMM d, yyyy"), " • 5 min read</div>"]))
        .when(kind == 4, put("<body>", ["<p>Published on <b>", F.date_format(day, "d MMMM yyyy"), "</b></p>"]))
        .otherwise(html)
    )
    changed = F.concat(F.lit('<meta property="article:modified_time" content="2024-01-30">'), page)
    return table(spark, d, "pages").select("page_id", dates.published_in_html(changed).alias("published_raw")).withColumn("ms", dates.parse_date_ms(F.col("published_raw"), NOW_MS))


@query("date_forms", f"WITH {ENTRIES} SELECT doc_id, CASE doc_id % 12 WHEN 11 THEN NULL WHEN 0 THEN published_ms // 86400000 * 86400000 WHEN 1 THEN published_ms // 86400000 * 86400000 WHEN 2 THEN published_ms // 86400000 * 86400000 WHEN 3 THEN published_ms - 28800000 WHEN 4 THEN published_ms + 19800000 WHEN 5 THEN published_ms // 3600000 * 3600000 ELSE published_ms END AS ms FROM entries")
def date_forms(spark, d):
    """Times of entries in the forms that feeds and pages write: days, zones, halves of the day, names in either order."""
    stamp = F.timestamp_millis(F.col("published_ms"))
    forms = ["EEEE, MMMM d, yyyy", "d-MMM-yy", "dd 'of' MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss'+08:00'", "d MMM yyyy HH:mm '-0530'", "MMM. d, yyyy 'at' ha", "M/d/yyyy h:mm a", "yyyyMMdd'T'HHmmss", "EEE MMM dd HH:mm:ss 'UTC' yyyy", "yyyy.MM.dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "MMMM yyyy"]
    raw = F.element_at(F.array(*[F.date_format(stamp, form) for form in forms]), (F.col("doc_id") % len(forms) + 1).cast("int"))
    return entries(spark, d).select("doc_id", raw.alias("raw")).select("doc_id", dates.parse_date_ms(F.col("raw"), NOW_MS).alias("ms"))


@query("display_media", f"""WITH {ENTRIES}, e AS (
  SELECT doc_id, content_type AS kind, 'https://e.org/' || left(md5(title), 8) || '.png' AS a, 'https://e.org/' || CASE WHEN doc_id % 3 = 0 THEN 'avatar' ELSE '' END || left(md5(body), 8) || '.png' AS b,
    CASE WHEN doc_id % 2 = 0 THEN 'https://e.org/t' || doc_id || '.jpg' ELSE '' END AS film, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://e.org/logo.png' ELSE 'https://e.org/o' || doc_id || '.png' END AS own,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://e.org/author-photo.png' ELSE 'https://e.org/c' || doc_id || '.png' END AS cover FROM entries
), k AS (SELECT *, doc_id % 3 > 0 AS both_good, own LIKE '%/o%' AS own_good, cover LIKE '%/c%' AS cover_good FROM e
), r AS (
  SELECT doc_id, CASE WHEN kind = '视频' AND film <> '' THEN film WHEN kind = '视频' THEN own WHEN kind = '播客' AND own_good THEN own WHEN kind = '播客' AND own = '' THEN a WHEN kind = '播客' THEN ''
      WHEN kind = '文章' AND cover_good THEN cover WHEN kind = '文章' AND own_good THEN own WHEN kind = '文章' THEN a ELSE own END AS image_url,
    CASE WHEN kind = '视频' AND film <> '' THEN film || '=video-cover' WHEN kind = '视频' AND own_good THEN own || '=video-cover' WHEN kind = '视频' THEN a || '='
      WHEN kind = '播客' AND own_good THEN own || '=podcast-cover' WHEN kind = '播客' AND own = '' THEN a || '=podcast-cover' WHEN kind = '播客' THEN a || '='
      WHEN kind = '文章' AND cover_good THEN cover || '=article-cover' WHEN kind = '文章' AND own_good THEN own || '=article-cover' WHEN kind = '文章' THEN a || '=article-cover'
      WHEN both_good THEN a || '=|' || b || '=' ELSE a || '=' END AS images FROM k)
SELECT * FROM r""")
def display_media(spark, d):
    """Entries with two pictures by their title and text, a third of which are portraits, and covers of several kinds."""
    n = F.col("doc_id").cast("string")
    link = lambda *parts: F.concat(F.lit("https://e.org/"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    asset = lambda u: F.struct(u.alias("url"), F.col("title").alias("alt"), F.lit("").alias("kind"))
    name = lambda c: F.left(F.md5(F.col(c).cast("binary")), F.lit(8))
    by = lambda k, *cases: F.element_at(F.array(*cases), (F.col("doc_id") % k + 1).cast("int"))
    none, own, cover = F.lit(""), link("o", n, ".png"), link("c", n, ".png")
    images = F.array(asset(link(name("title"), ".png")), asset(link(F.when(F.col("doc_id") % 3 == 0, "avatar").otherwise(""), name("body"), ".png")))
    shown = pictures.display_media(F.col("content_type"), images, by(2, link("t", n, ".jpg"), none), by(4, none, link("logo.png"), own, own), by(5, none, link("author-photo.png"), cover, cover, cover), F.col("title"))
    rows = entries(spark, d).select("doc_id", shown.alias("m"))
    return rows.select("doc_id", "m.image_url", F.array_join(F.transform("m.images", lambda x: F.concat(x["url"], F.lit("="), x["kind"])), "|").alias("images"))


@query("brief_pictures", f"""WITH {ENTRIES}, e AS (
  SELECT source_id, doc_id, 'https://e.org/' || left(md5(title), 8) || '.png' AS own, 'https://e.org/c' || left(md5(lang || published_ms // 1000000), 5) || '.png' AS cover FROM entries
), f AS (SELECT *, row_number() OVER (PARTITION BY source_id, own ORDER BY doc_id) = 1 AS shows FROM e
), c AS (SELECT *, NOT shows AND row_number() OVER (PARTITION BY source_id, cover, shows ORDER BY doc_id) = 1 AS covers FROM f)
SELECT source_id, doc_id, CASE WHEN shows THEN own || CASE WHEN doc_id % 2 = 0 THEN '?w=' || doc_id ELSE '' END WHEN covers THEN coalesce(cover, '') ELSE '' END AS image_url FROM c""")
def brief_pictures(spark, d):
    """Entries of a source as its brief: pictures by title, so that copies ask for the same one, and covers that others share."""
    rows = entries(spark, d)
    own = F.concat(F.lit("https://e.org/"), F.left(F.md5(F.col("title").cast("binary")), F.lit(8)), F.lit(".png"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("?w="), F.col("doc_id").cast("string"))).otherwise(""))
    day = F.concat(F.col("lang"), F.floor(F.col("published_ms") / 1_000_000).cast("string"))
    cover = F.concat(F.lit("https://e.org/c"), F.left(F.md5(day.cast("binary")), F.lit(5)), F.lit(".png"))
    asked = rows.select("source_id", "doc_id", own.alias("own"), cover.alias("cover"))
    return one_picture_each(asked, ["source_id"], "doc_id", "own", "cover").select("source_id", "doc_id", "image_url")


@query("proxy_articles", rf"""WITH md AS (
  SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS title, doc_id % 28 + 1 AS day,
    chr(10) || regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(?m)^(\S+)', '![\1](/i/\1.png) [\1](/l/\1)', 'g') AS body FROM documents WHERE text IS NOT NULL
), pics AS (
  SELECT doc_id, unnest(found) AS link, generate_subscripts(found, 1) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(body, '!\[([^\]]*)\]\(([^)\s]+)[^)]*\)', 2), lambda x: 'https://e.org' || x) AS found FROM md WHERE title <> '')
), shown AS (
  SELECT doc_id, string_agg(link, '|' ORDER BY i) AS images FROM (
    SELECT doc_id, arg_min(link, i) AS link, min(i) AS i FROM pics WHERE NOT regexp_matches(link, '{pictures.NO_CONTENT}') AND NOT regexp_matches(lower(split_part(link, '?', 1)), '\.svg$') GROUP BY doc_id, split_part(link, '?', 1)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 4) GROUP BY 1
), plain AS (
  SELECT doc_id, title, day, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
    '!\[([^\]]*)\]\(([^)\s]+)[^)]*\)', ' ', 'g'), '\[([^\]]*)\]\(([^)\s]+)[^)]*\)', '\1', 'g'), '(?m)^#{{2,6}}\s*', '## ', 'g'), '(?m)^#\s*', '', 'g'),
    '(?m)^\s*[-*=_]{{3,}}\s*$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM md WHERE title <> ''
), parts AS (
  SELECT doc_id, regexp_replace(para, '^\s+|\s+$', '', 'g') AS line, i FROM (
    SELECT doc_id, unnest(string_split(body, chr(10) || chr(10))) AS para, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i FROM plain)
), unlabelled AS (
  SELECT * FROM parts WHERE line <> '' AND NOT (regexp_matches(line, '{article.LABEL_LINE}') AND (length(line) < 40 OR NOT regexp_matches(line, '{article.SENTENCE_END}')))
), once AS (SELECT * FROM unlabelled QUALIFY line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY i)
), tested AS (SELECT *, NOT regexp_matches(line, '{article.SENTENCE_END}') AS open_end, string_split_regex(line, '\s+') AS words FROM once
), ended AS (
  SELECT doc_id, line, i, max(CASE WHEN NOT ((regexp_matches(line, '{article.RIGHTS_LINE}') AND length(line) < 60) OR (length(line) <= 30 AND open_end)
    OR (length(line) <= 80 AND open_end AND NOT regexp_matches(line, '[,，]') AND len(words) >= 3 AND len(list_filter(words, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= len(words) * 0.7)) THEN i END) OVER (PARTITION BY doc_id) AS last FROM tested
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, lower(regexp_replace(line, '[^\pL\pN_]+', '', 'g')) AS letters,
    lower(regexp_replace(title, '[^\pL\pN_]+', '', 'g')) AS title FROM ended JOIN plain USING (doc_id) WHERE i <= last
), leads AS (
  SELECT *, regexp_matches(line, '{article.DATE_LINE}') AS dated, (title <> '' AND (contains(title, letters) OR (contains(letters, title) AND length(letters) <= length(title) * 1.6)))
    OR regexp_matches(line, '{article.DATE_LINE}') OR regexp_matches(line, '{article.LEAD_LINE}') OR (length(line) < 45 AND NOT regexp_matches(line, '{article.SENTENCE_END}')) AS leads FROM lines
), begun AS (SELECT *, min(CASE WHEN NOT leads THEN i END) OVER (PARTITION BY doc_id) AS start FROM leads
), texts AS (
  SELECT doc_id, left(coalesce(nullif(regexp_replace(string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (i >= start AND (i - start > 2 OR NOT dated)), '^\s+|\s+$', '', 'g'), ''), string_agg(line, chr(10) || chr(10) ORDER BY i)), 15000) AS body FROM begun GROUP BY 1)
SELECT doc_id, title, '2024-01-' || lpad(CAST(day AS VARCHAR), 2, '0') AS published_raw, coalesce(images, '') AS images, md5(coalesce(texts.body, '')) AS body FROM plain LEFT JOIN texts USING (doc_id) LEFT JOIN shown USING (doc_id)""")
def proxy_articles(spark, d):
    """Documents as pages that a proxy gave: the first word of every line is a picture and a link of that name."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    body = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), r"(?Umd)^(\S+)", r"![$1](/i/$1.png) [$1](/l/$1)")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    page = F.concat(F.lit("Title: Paper page - "), F.substring_index("text", "\n", 1), F.lit("\n\nPublished Time: 2024-01-"), day, F.lit("\n\nMarkdown Content:\n"), body)
    none = F.lit(None).cast("string")
    pages = docs.select("doc_id", page.alias("markdown"), F.concat(F.lit("https://e.org/p/"), F.col("doc_id").cast("string")).alias("url"), none.alias("title"), none.alias("published_raw"), none.alias("community_block"))
    links = F.array_join(F.transform("images", lambda x: x["url"]), "|")
    return markdown.proxy_items(pages).select("doc_id", "title", "published_raw", links.alias("images"), F.md5(F.col("body").cast("binary")).alias("body"))
