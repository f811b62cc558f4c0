"""Queries over documents as the pages of papers and policies, and over parts as repositories with their releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.operators import papers, repos
from briefloom.plans.registry import query
from briefloom.plans.views import table

#: Lines that count as headings and captions in the language of the test tables.
HEADINGS = {"摘要": "the .*", "方法": "(?:in|to) .*", "结果": "(?:de|la|le) .*", "结论": "(?:and|et|und) .*"}
CAPTION = "^(?:an|of|en|re|der|du) "
DUTIES, SUBJECTS = "(?:tion|ment|ble)", "(?:the|que|sch)"
PAGE_LINES = 5

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = rf"""lines AS (
  SELECT doc_id, i - 1 AS i, (i - 1) // {PAGE_LINES} + 1 AS page, {_STRIP.format('line')} AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
)"""
_W = r"[\pL\pM\pN_]"


def _joined(text: str) -> str:
    """Words divided at line ends, as a section's text has them."""
    halves = text
    for _ in range(2):
        halves = rf"regexp_replace({halves}, '({_W})-\n({_W})', '\1\2', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({halves}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _cleaned(text: str) -> str:
    """The same for a policy's page, where blanks may surround the line's end."""
    halves = text
    for _ in range(2):
        halves = rf"regexp_replace({halves}, '({_W})-\s*\n\s*({_W})', '\1\2', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({halves}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def document_pages(spark, d):
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(PAGE_LINES)), lambda at: F.array_join(F.slice("lines", at, PAGE_LINES), "\n"))
    return lines.select("doc_id", F.posexplode(starts).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


@query("paper_sections", rf"""WITH RECURSIVE {_LINES}, named AS (
  SELECT doc_id, i, line, CASE WHEN length(plain) > {papers.HEADING_CHARS} THEN NULL {' '.join(f"WHEN regexp_full_match(plain, '(?i){pattern}') THEN '{name}'" for name, pattern in HEADINGS.items())} END AS head
  FROM (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g'), ' ' || chr(9) || '.:') AS plain FROM lines)
), carried AS (
  SELECT doc_id, i, line, head, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '{papers.BODY}') AS section FROM named
), whole AS (
  SELECT doc_id, section, list_position({list(papers.ORDER)}, section) AS rank, {_joined("string_agg(line, chr(10) ORDER BY i)")} AS text FROM carried WHERE head IS NULL AND line <> '' GROUP BY doc_id, section
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS k FROM whole WHERE text <> ''
), walk AS (
  SELECT doc_id, 0 AS k, '' AS section, '' AS excerpt, {papers.EVIDENCE_CHARS}::BIGINT AS rest FROM ranked GROUP BY doc_id
  UNION ALL
  SELECT r.doc_id, r.k, r.section, {_STRIP.format(f"r.text[:least({papers.SECTION_CHARS}, w.rest)]")}, w.rest - length({_STRIP.format(f"r.text[:least({papers.SECTION_CHARS}, w.rest)]")}) FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.k = w.k + 1 WHERE w.rest > 0
)
SELECT doc_id, section, excerpt FROM walk WHERE excerpt <> ''""")
def paper_sections(spark, d):
    found = papers.section_evidence(document_pages(spark, d), "doc_id", "page", "text", HEADINGS)
    return found.select("doc_id", F.inline("sections")).select("doc_id", F.col("title").alias("section"), F.col("text").alias("excerpt"))


def _captions_sql(lines: str) -> str:
    return rf"""filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS k FROM {lines} WHERE line <> ''
), told AS (
  SELECT doc_id, page, i, left(concat_ws(' ', line, lead(line, 1) OVER w, lead(line, 2) OVER w), {papers.CAPTION_CHARS}) AS caption,
    regexp_matches(line, '(?i){CAPTION}') AND length(trim(regexp_replace(line, '(?i){CAPTION}', ''), ' .|:—-')) >= {papers.CAPTION_LEAST} AS is_caption
  FROM filled WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)
), captions AS (SELECT doc_id, page, caption, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) AS place FROM told WHERE is_caption QUALIFY place <= {papers.CAPTIONS}
), shown AS (
  SELECT doc_id, page FROM captions GROUP BY doc_id, page
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY max(1 + CASE WHEN regexp_matches(caption, '(?i){papers.TELLING}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(caption, '(?i)^\s*(?:table|表)\b') THEN 2 ELSE 0 END) DESC, page) <= {papers.VISUAL_PAGES}
)"""


@query("paper_captions", f"WITH {_LINES}, {_captions_sql('lines')} SELECT doc_id, CAST(page AS INT) AS page, CAST(place AS INT) AS place, caption, s.page IS NOT NULL AS visual FROM captions LEFT JOIN shown s USING (doc_id, page)")
def paper_captions(spark, d):
    told = papers.captions(document_pages(spark, d), "doc_id", "page", "text", CAPTION)
    shown = papers.visual_pages(told, "doc_id", "page").select("doc_id", F.explode("pages").alias("page"), F.lit(True).alias("shown"))
    return told.join(shown, ["doc_id", "page"], "left").select("doc_id", "page", "place", "caption", F.coalesce("shown", F.lit(False)).alias("visual"))


@query("policy_pages", rf"""WITH {_LINES.replace("lines AS", "raw AS")}, pages AS (SELECT doc_id, page, {_cleaned("string_agg(line, chr(10) ORDER BY i)")} AS text FROM (
    SELECT doc_id, page, i, lines_of[i + 1] AS line FROM raw JOIN (SELECT doc_id, string_split(text, chr(10)) AS lines_of FROM documents) USING (doc_id)) GROUP BY doc_id, page
), lines AS (SELECT doc_id, page, i, {_STRIP.format('line')} AS line FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages)
), {_captions_sql('lines')}, scored AS (
  SELECT p.doc_id, p.page, p.text, s.page IS NOT NULL AS visual,
    {papers.DUTY_POINTS} * len(regexp_extract_all(text, '(?i){DUTIES}')) + {papers.SUBJECT_POINTS} * len(regexp_extract_all(text, '(?i){SUBJECTS}')) + CASE WHEN s.page IS NULL THEN 0 ELSE {papers.VISUAL_POINTS} END AS points
  FROM pages p LEFT JOIN shown s USING (doc_id, page) WHERE p.text <> ''
), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page <= {papers.HEAD_PAGES} THEN 0 WHEN visual THEN 1 ELSE 2 END, page) AS first FROM scored
), taken AS (
  SELECT doc_id, page, '[PDF 第 ' || page || ' 页]' || chr(10) || text AS chunk, row_number() OVER w AS nth, coalesce(sum(length('[PDF 第 ' || page || ' 页]' || chr(10) || text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY least(first, {papers.HEAD_PAGES + 1}), CASE WHEN first <= {papers.HEAD_PAGES} THEN 0 ELSE -points END, page)
)
SELECT doc_id, CAST(page AS INT) AS page, CAST(nth AS INT) AS nth, left(chunk, {papers.DOCUMENT_CHARS} - used) AS excerpt FROM taken WHERE used < {papers.DOCUMENT_CHARS}""")
def policy_pages(spark, d):
    pages = document_pages(spark, d)
    cleaned = pages.withColumn("text", papers.join_hyphens(F.col("text"), over_blanks=True))
    shown = papers.visual_pages(papers.captions(cleaned, "doc_id", "page", "text", CAPTION), "doc_id", "page")
    return papers.chosen_pages(pages, shown, "doc_id", "page", "text", papers.DOCUMENT_CHARS, DUTIES, SUBJECTS)


# The moment and the words of the test tables under which parts are repositories and their lines are releases.
REPO_NOW_MS = 1_005_350_400_000
RULES = repos.RepoRules(REPO_NOW_MS, most=40, least_stars=900, least_new_stars=500, topics=("economy", "small"), excluded_topics=("promo",), subject="(widget|ring)", excluded_name="(green)")


@query("repository_list", f"""WITH p AS (
  SELECT p_partkey, p_brand || '/' || p_name || '-' || p_partkey AS full_name, p_name, lower(p_type) AS topic, (p_partkey * 7919) % 60000 AS stars, p_size * 10 AS forks, (p_partkey * 31) % 300 AS created_days, (p_partkey * 17) % 120 AS pushed_days, p_size FROM part
), s AS (
  SELECT *, created_days <= {RULES.release_days} AS is_new, log10(stars + 1) + 0.5 * log10(forks + 1) + CASE WHEN created_days <= {RULES.release_days} THEN 1.2 ELSE 0 END + CASE WHEN topic IN ('economy', 'small') THEN 0.5 ELSE 0 END + CASE WHEN pushed_days <= {RULES.active_days} THEN 0.3 ELSE 0 END AS score
  FROM p WHERE (p_size >= 5 OR created_days <= {RULES.release_days}) AND stars >= CASE WHEN created_days <= {RULES.release_days} THEN {RULES.least_new_stars} ELSE {RULES.least_stars} END
    AND forks >= CASE WHEN created_days <= {RULES.release_days} THEN {RULES.least_new_forks} ELSE {RULES.least_forks} END AND NOT contains(full_name, 'green') AND topic <> 'promo' AND (topic IN ('economy', 'small') OR regexp_matches(full_name, 'widget|ring'))
), n AS (SELECT * FROM s WHERE is_new ORDER BY score DESC, stars DESC, p_partkey LIMIT {RULES.most_new}
), a AS (SELECT * FROM s WHERE NOT is_new ORDER BY score DESC, stars DESC, p_partkey LIMIT {RULES.most_lookups}
), r AS (
  SELECT l_partkey, 'v' || l_orderkey || '.' || l_linenumber AS tag, l_shipdate FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey % 7 > 1
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1
), u AS (
  SELECT full_name, is_new, full_name AS title, score, stars, p_partkey FROM n
  UNION ALL
  SELECT full_name, is_new, full_name || ' ' || tag, score, stars, p_partkey FROM a JOIN r ON l_partkey = p_partkey WHERE {REPO_NOW_MS} - epoch_ms(l_shipdate) <= {RULES.release_days * 86_400_000}
)
SELECT full_name, is_new, title, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, stars DESC, p_partkey) AS INT) AS nth FROM u QUALIFY nth <= {RULES.most}""")
def repository_list(spark, d):
    """Parts by two routes that overlap; a seventh has no release feed, a seventh an empty one, a third of all releases come early."""
    k, day = F.col("p_partkey"), 86_400_000
    rows = table(spark, d, "part").select(
        k,
        F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), k.cast("string")).alias("full_name"),
        F.col("p_name").alias("description"),
        F.array("p_type").alias("topics"),
        F.lit("").alias("language"),
        (k * 7919 % 60_000).alias("stars"),
        (F.col("p_size") * 10).alias("forks"),
        (REPO_NOW_MS - (k * 31 % 300) * day).alias("created_ms"),
        (REPO_NOW_MS - (k * 17 % 120) * day).alias("pushed_ms"),
        F.col("p_size").alias("size"),
    )
    found = repos.scored(repos.pool(rows.where("size >= 5"), rows.where(k * 31 % 300 <= RULES.release_days), "p_partkey"), RULES)
    lines = table(spark, d, "lineitem").where("l_partkey % 7 > 0")
    tag = F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "rc1").otherwise(""))
    entry = F.concat(F.lit("<entry><title>"), tag, F.lit("</title><updated>"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("late"), "l_orderkey", "l_linenumber", entry.alias("entry"))))
    feed = F.concat(F.lit("<feed>"), F.array_join(F.transform(ordered, lambda e: e["entry"]), ""))
    feeds = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(feed.alias("feed")).join(rows.select("p_partkey", "full_name"), "p_partkey")
    feeds = feeds.select("full_name", F.when(k % 7 == 1, "").otherwise(F.col("feed")).alias("feed"))
    return repos.repository_items(found, feeds, RULES, "p_partkey").select("full_name", "is_new", "title", F.round("score", 6).alias("score"), "nth")
