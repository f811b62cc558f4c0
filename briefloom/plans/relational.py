"""Queries over joins, aggregates, windows, set operations, the funnel, selection and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from briefloom.config import EngineConfig, Quotas
from briefloom.functions import dates, scoring, similarity, text
from briefloom.operators import briefs, clean, events, reports, select, social, typed
from briefloom.plans.registry import query
from briefloom.plans.views import ENTRIES, NOW_MS, SOURCES, START_MS, entries, sources_dim, table

CONFIG = EngineConfig(now_ms=NOW_MS)
WITH = f"WITH {ENTRIES}, {SOURCES}"
# The funnel's tests over the test tables: the keyword is one that their language has.
KEYWORD = "tion"
TAGGED_SQL = f"""{WITH}, raw AS (
  SELECT e.*, s.lookback_hours, s.fetch_method, CASE WHEN doc_id % 50 = 0 THEN '' ELSE title END AS t,
    CASE WHEN doc_id % 40 = 1 THEN NULL ELSE published_ms END AS pub, md5(body) AS k
  FROM entries e JOIN sources_dim s USING (source_id)
), tagged AS (
  SELECT *, CASE WHEN trim(t) = '' THEN 'missing_title_url' WHEN regexp_matches(t, '(?i)^zu') THEN 'title_exclude_regex' WHEN pub IS NULL THEN 'missing_or_invalid_date'
    WHEN NOT {NOW_MS} - pub < lookback_hours * 3600000 THEN 'lookback'
    WHEN length(t || ' ' || body) < 1500 AND doc_id % 3 = 0 AND fetch_method NOT IN ('Media', 'Social') THEN 'min_content_chars'
    WHEN NOT (regexp_matches(t, '(?i)tion') OR len(regexp_extract_all(body, '(?i)tion')) >= CASE WHEN fetch_method = 'Podcast' THEN 3 ELSE 2 END) AND fetch_method <> 'Social' AND NOT fetch_method = 'Podcast' THEN 'keyword_regex'
    WHEN fetch_method = 'Podcast' AND NOT (regexp_matches(t, '(?i)tion') OR len(regexp_extract_all(body[1:1600], '(?i)tion')) >= 3) THEN 'keyword_regex' WHEN account % 11 = 0 THEN 'typed_filter' END AS r0
  FROM raw
), deduped AS (
  SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY r0 IS NULL, k ORDER BY doc_id) > 1 THEN 'dup_round' ELSE r0 END AS r1 FROM tagged
), capped AS (
  SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY r1 IS NULL, source_id ORDER BY doc_id) > 3 THEN 'per_feed_cap' ELSE r1 END AS drop_reason FROM deduped
)"""


def funnel_items(spark, d):
    met = entries(spark, d).join(F.broadcast(sources_dim(spark).drop("n")), "source_id")  # 25 rows
    return met.withColumns(
        {
            "title": F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("title")),
            "published_ms": F.when(F.col("doc_id") % 40 != 1, F.col("published_ms")),
            "url": F.concat(F.when(F.col("doc_id") % 3 == 0, "https://arxiv.org/abs/").otherwise("https://e.org/"), F.col("doc_id").cast("string")),
            "heat_keep": F.lit(False),
            "keyword_regex": F.lit(KEYWORD),
            "keyword_min_hits": F.lit(2),
            "title_exclude_regex": F.lit("^zu"),
            "min_content_chars": F.lit(1500),
            "key": F.md5(F.col("body")),
        }
    )


def tagged_items(spark, d):
    config = EngineConfig(now_ms=NOW_MS, kept_per_feed=3)
    return clean.clean(funnel_items(spark, d), config, "key", "source_id", ["doc_id"], F.col("account") % 11 == 0)


@query("funnel_counts", f"{TAGGED_SQL} SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM capped GROUP BY 1")
def funnel_counts(spark, d):
    return clean.funnel(tagged_items(spark, d))


@query("funnel_rows", f"{TAGGED_SQL} SELECT doc_id, drop_reason FROM capped")
def funnel_rows(spark, d):
    return tagged_items(spark, d).select("doc_id", "drop_reason")


@query("window_drop_audit", f"""{TAGGED_SQL} SELECT source_id, count(*) AS n FROM capped WHERE r0 = 'lookback' AND NOT (length(t || ' ' || body) < 1500 AND doc_id % 3 = 0 AND fetch_method NOT IN ('Media', 'Social')) AND (fetch_method = 'Social' OR (fetch_method = 'Podcast' AND (regexp_matches(t, '(?i)tion') OR len(regexp_extract_all(body[1:1600], '(?i)tion')) >= 3))
  OR (fetch_method NOT IN ('Social', 'Podcast') AND (regexp_matches(t, '(?i)tion') OR len(regexp_extract_all(body, '(?i)tion')) >= 2))) GROUP BY source_id""")
def window_drop_audit(spark, d):
    tagged = clean.tag_reasons(funnel_items(spark, d), CONFIG)
    return tagged.where("window_only").groupBy("source_id").agg(F.count("*").alias("n"))


@query("drop_samples", f"{TAGGED_SQL} SELECT drop_reason, doc_id, nth FROM (SELECT drop_reason, doc_id, row_number() OVER (PARTITION BY drop_reason ORDER BY doc_id) AS nth FROM capped WHERE drop_reason IS NOT NULL) WHERE nth <= 12")
def drop_samples(spark, d):
    return reports.samples(tagged_items(spark, d), "drop_reason", 12, ["doc_id"]).select("drop_reason", "doc_id", F.col("nth").cast("long").alias("nth"))


@query("source_stats", f"""{TAGGED_SQL} SELECT s.source_id, CAST(coalesce(c.n, 0) AS BIGINT) AS cleaned, CAST(coalesce(f.n, 0) AS BIGINT) AS final, CAST(coalesce(w.n, 0) AS BIGINT) AS window_drops, CAST(greatest(coalesce(c.n, 0) - coalesce(f.n, 0), 0) AS BIGINT) AS dedup
FROM sources_dim s LEFT JOIN (SELECT source_id, count(*) AS n FROM capped WHERE r0 IS NULL GROUP BY 1) c USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM capped WHERE drop_reason IS NULL GROUP BY 1) f USING (source_id)
LEFT JOIN (SELECT source_id, count(*) AS n FROM capped WHERE r0 = 'lookback' GROUP BY 1) w USING (source_id)""")
def source_stats(spark, d):
    tagged = tagged_items(spark, d)
    passed = tagged.where("drop_reason IS NULL OR drop_reason IN ('dup_round', 'per_feed_cap')")
    return reports.source_statistics(sources_dim(spark), passed, tagged.where("drop_reason IS NULL"), tagged.where("drop_reason = 'lookback'"), "source_id")


@query("dedup_first", f"WITH {ENTRIES} SELECT k, min(doc_id) AS doc_id FROM (SELECT md5(body) AS k, doc_id FROM entries) GROUP BY k")
def dedup_first(spark, d):
    rows = entries(spark, d).select(F.md5("body").alias("k"), "doc_id")
    return clean.first_by(rows, "k", ["doc_id"])


@query("feed_cap", f"WITH {ENTRIES} SELECT source_id, doc_id FROM (SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS r FROM entries) WHERE r <= 10")
def feed_cap(spark, d):
    rows = entries(spark, d).select("source_id", "doc_id", F.lit(None).cast("string").alias("drop_reason"))
    return clean.mark_over_cap(rows, "source_id", 10, ["doc_id"]).where("drop_reason IS NULL").select("source_id", "doc_id")


@query("new_items_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def new_items_anti(spark, d):
    key = F.col("doc_id").cast("string")
    items, stored = table(spark, d, "documents").select("doc_id", key.alias("key")), table(spark, d, "labels").select(key.alias("key"))
    return clean.new_items(items, stored, "key").select("doc_id")


@query("typed_cfg_first_wins", "SELECT source_id, min(t) AS tab FROM (SELECT 'src' || CAST(c_custkey % 30 AS VARCHAR) AS source_id, 1 AS t FROM customer UNION ALL SELECT 'src' || CAST(s_suppkey % 40 AS VARCHAR), 2 FROM supplier) GROUP BY source_id")
def typed_cfg_first_wins(spark, d):
    a = table(spark, d, "customer").select(F.concat(F.lit("src"), (F.col("c_custkey") % 30).cast("string")).alias("source_id"), F.lit(1).alias("tab"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("src"), (F.col("s_suppkey") % 40).cast("string")).alias("source_id"), F.lit(2).alias("tab"))
    return typed.first_wins([a, b], "source_id")


@query("typed_filter_reason", f"""WITH {ENTRIES} SELECT doc_id, CASE WHEN NOT contains(lower(body), 'the') THEN 'keyword_include' WHEN contains(lower(body), 'zzz') THEN 'keyword_exclude' WHEN length(body) < 300 THEN 'min_chars'
 WHEN quality < 20 THEN 'min_quality_score' WHEN doc_id % 7 = 0 THEN 'max_duration_sec' WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'require_community_heat' WHEN doc_id % 11 = 0 THEN 'exclude_ad' END AS reason FROM entries""")
def typed_filter_reason(spark, d):
    k = F.col("doc_id")
    params = {"keyword_include": F.array(F.lit("the")), "keyword_exclude": F.array(F.lit("zzz")), "min_content_chars": F.lit(300), "min_quality_score": F.lit(20), "max_duration_sec": F.lit(100), "require_community_heat": k % 5 == 0, "exclude_ad": F.lit(True)}
    metrics = {"quality_score": F.col("quality"), "duration_sec": F.when(k % 7 == 0, 200), "community_heat": F.when(k % 2 == 1, 3.0), "is_ad": k % 11 == 0}
    reason = typed.typed_reason(F.lit("video"), params, metrics, F.lower("body"), F.length("body"))
    return entries(spark, d).select("doc_id", reason.alias("reason"))


@query("hard_filter_reason", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'retweet' WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'reply' WHEN doc_id % 4 = 1 THEN 'noise' WHEN doc_id % 4 = 2 THEN 'short' END AS reason FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0")
def hard_filter_reason(spark, d):
    k = F.col("doc_id")
    body = F.element_at(F.array(*map(F.lit, ("see https://e.org/x", "good morning to all of you out there today", "tiny", "a remark of some length that says little but is long"))), (k % 4 + 1).cast("int"))
    reason = social.hard_reason(body, body, k % 9 == 0, k % 5 == 0, F.lit(1), F.lit(False), F.lit(True), F.lit(None).cast("int"))
    return table(spark, d, "documents").where("doc_id % 5 <> 0 OR doc_id % 2 = 0").select("doc_id", reason.alias("reason"))


@query("active_semi", f"{WITH} SELECT e.doc_id FROM entries e WHERE source_id IN (SELECT source_id FROM sources_dim WHERE status = 'active')")
def active_semi(spark, d):
    return entries(spark, d).join(sources_dim(spark).where("status = 'active'"), "source_id", "left_semi").select("doc_id")


@query("candidate_window", f"{WITH} SELECT e.doc_id FROM entries e LEFT JOIN sources_dim s USING (source_id) WHERE published_ms BETWEEN {NOW_MS} - least(168, greatest(1, coalesce(lookback_hours, 168))) * 3600000 AND {NOW_MS} + 172800000")
def candidate_window(spark, d):
    met = entries(spark, d).join(F.broadcast(sources_dim(spark).select("source_id", "lookback_hours")), "source_id", "left")  # 25 rows
    return met.where(clean.in_selection_window(F.col("published_ms"), F.col("lookback_hours"), NOW_MS)).select("doc_id")


@query("contribution", f"{WITH}, c AS (SELECT source_id, count(*) AS n, max(published_ms) AS last_ms FROM entries WHERE source_id <> 'src3' OR doc_id % 2 = 0 GROUP BY 1), s AS (SELECT source_id FROM sources_dim WHERE n <> 4) SELECT coalesce(c.source_id, s.source_id) AS source_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n, last_ms, s.source_id IS NOT NULL AS in_param, round(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY coalesce(c.n, 0) DESC) AS INT) AS rank FROM c FULL JOIN s ON c.source_id = s.source_id")
def contribution(spark, d):
    rows = entries(spark, d).where("source_id <> 'src3' OR doc_id % 2 = 0")
    out = reports.contribution(rows, sources_dim(spark).where("n <> 4"), "source_id", "published_ms")
    return out.withColumn("share", F.round("share", 6))


@query("zero_output", f"{WITH} SELECT source_id FROM sources_dim WHERE source_id NOT IN (SELECT source_id FROM entries)")
def zero_output(spark, d):
    return sources_dim(spark).join(entries(spark, d).select("source_id").distinct(), "source_id", "left_anti").select("source_id")


@query("orphans", f"{WITH} SELECT source_id, count(*) AS n FROM entries WHERE source_id NOT IN (SELECT source_id FROM sources_dim WHERE n < 15) GROUP BY 1")
def orphans(spark, d):
    return entries(spark, d).join(sources_dim(spark).where("n < 15").select("source_id"), "source_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


BRIEFS_SQL = f"briefs AS (SELECT strftime(make_timestamp((published_ms + 28800000) * 1000), '%Y-%m-%d') AS date, list(CAST(doc_id AS VARCHAR) ORDER BY quality DESC, doc_id)[1:5] AS ids, count(*) AS n FROM entries GROUP BY 1)"


def brief_table(spark, d):
    """One brief a day: the JSON array of its five best entries."""
    day = entries(spark, d).select(dates.cn_day(F.col("published_ms")).alias("date"), "doc_id", "quality")
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("quality"), "doc_id"))
    best = day.withColumn("r", rank).where("r <= 5")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("doc_id").cast("string").alias("id")))), lambda x: x["id"])
    return best.groupBy("date").agg(F.to_json(ids).alias("record_ids"))


@query("brief_entries", f"WITH {ENTRIES}, {BRIEFS_SQL} SELECT date, CAST(i - 1 AS BIGINT) AS place, CAST(ids[i] AS BIGINT) AS doc_id FROM (SELECT date, ids, unnest(range(1, len(ids) + 1)) AS i FROM briefs)")
def brief_entries(spark, d):
    out = briefs.brief_entries(brief_table(spark, d), entries(spark, d).select("doc_id"), "record_ids", "doc_id")
    return out.select("date", F.col("place").cast("long").alias("place"), "doc_id")


@query("brief_window", f"{WITH} SELECT doc_id, coalesce(CASE WHEN lookback_hours IS NULL THEN true ELSE published_ms BETWEEN {NOW_MS} - least(168, greatest(1, lookback_hours)) * 3600000 AND {NOW_MS} END, false) AS inside FROM entries e LEFT JOIN (SELECT * FROM sources_dim WHERE n < 10) s USING (source_id)")
def brief_window(spark, d):
    hours = sources_dim(spark).where("n < 10").select("source_id", "lookback_hours")
    met = entries(spark, d).join(F.broadcast(hours), "source_id", "left")  # 10 rows
    return met.select("doc_id", briefs.in_brief_window(F.col("published_ms"), F.lit(NOW_MS), F.col("lookback_hours")).alias("inside"))


@query("brief_counts", f"{WITH}, {BRIEFS_SQL}, x AS (SELECT unnest(ids) AS id FROM briefs) SELECT s.source_id, CAST(count(e.doc_id) AS BIGINT) AS n FROM sources_dim s LEFT JOIN (SELECT e.* FROM entries e JOIN x ON CAST(e.doc_id AS VARCHAR) = x.id) e USING (source_id) GROUP BY 1")
def brief_counts(spark, d):
    shown = briefs.brief_entries(brief_table(spark, d), entries(spark, d).select("doc_id", "source_id"), "record_ids", "doc_id")
    counts = shown.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources_dim(spark).select("source_id").join(counts, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("briefs_latest7", f"WITH {ENTRIES}, {BRIEFS_SQL} SELECT date, CAST(len(ids) AS BIGINT) AS n FROM briefs ORDER BY date DESC LIMIT 7")
def briefs_latest7(spark, d):
    return briefs.newest(brief_table(spark, d)).select("date", F.size(F.from_json("record_ids", "array<string>")).cast("long").alias("n"))


@query("brief_union_limit", f"WITH {ENTRIES}, {BRIEFS_SQL} SELECT date, mark FROM (SELECT '2024-01-20' AS date, 'current' AS mark UNION ALL SELECT date, 'stored' FROM briefs WHERE date <> '2024-01-20') ORDER BY date DESC LIMIT 7")
def brief_union_limit(spark, d):
    history = brief_table(spark, d).select("date", F.lit("stored").alias("mark"))
    current = spark.range(1).select(F.lit("2024-01-20").alias("date"), F.lit("current").alias("mark"))
    return briefs.with_current(history, current)


@query("upsert_brief", f"WITH {ENTRIES}, {BRIEFS_SQL} SELECT coalesce(a.date, b.date) AS date, coalesce(b.title, a.title) AS title, coalesce(a.send_status, '待发送') AS send_status FROM (SELECT date, 'old' AS title, '已发送' AS send_status FROM briefs WHERE date < '2024-01-20') a FULL JOIN (SELECT date, 'new' AS title FROM briefs WHERE date >= '2024-01-18') b ON a.date = b.date")
def upsert_brief(spark, d):
    days = brief_table(spark, d)
    stored = days.where("date < '2024-01-20'").select("date", F.lit("old").alias("title"), F.lit("已发送").alias("send_status"))
    return briefs.upsert_briefs(stored, days.where("date >= '2024-01-18'").select("date", F.lit("new").alias("title")))


@query("batch_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def batch_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return briefs.without(briefs.updated(orders, changes, "o_orderkey"), orders.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("report_stats", f"WITH {ENTRIES} SELECT count(*) AS total, count(DISTINCT source_id) AS sources, count(*) FILTER (quality >= 80) AS high, count(*) FILTER (event_type = 'error') AS urgent FROM entries")
def report_stats(spark, d):
    return entries(spark, d).agg(F.count("*").alias("total"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("quality") >= 80).alias("high"), F.count_if(F.col("event_type") == "error").alias("urgent"))


@query("topic_top8", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS value FROM benchmark) GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def topic_top8(spark, d):
    return reports.top_values(table(spark, d, "benchmark"), F.split("text", " "), 8)


@query("cohort_rollup", "SELECT event_type AS cohort, count(DISTINCT user_id) AS sources, count(*) FILTER (value > 50) AS with_links, count(*) AS n FROM events GROUP BY 1")
def cohort_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cohort")).agg(F.count_distinct("user_id").alias("sources"), F.count_if(F.col("value") > 50).alias("with_links"), F.count("*").alias("n"))


@query("source_diag", f"{TAGGED_SQL} SELECT source_id, count(*) AS raw, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason = 'lookback') AS lookback, round(avg(length(body)), 4) AS avg_chars FROM capped GROUP BY 1")
def source_diag(spark, d):
    return tagged_items(spark, d).groupBy("source_id").agg(F.count("*").alias("raw"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count_if(F.col("drop_reason") == "lookback").alias("lookback"), F.round(F.avg(F.length("body")), 4).alias("avg_chars"))


@query("thread_merge", rf"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM conversations)
SELECT conv_id * 1000 + 1 AS thread, string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (s <> '') AS body, count(*) AS thread_count, conv_id * 1000 + coalesce(max(turn) FILTER (turn = 1), min(turn)) AS root_id,
  left(regexp_replace(arg_min(s, turn) FILTER (s <> ''), '\s+', ' ', 'g'), {social.TITLE_CHARS}) || CASE WHEN length(regexp_replace(arg_min(s, turn) FILTER (s <> ''), '\s+', ' ', 'g')) > {social.TITLE_CHARS} THEN '{social.TITLE_CUT}' ELSE '' END AS title,
  sum(coalesce(length(text), 0))::BIGINT AS chars
FROM t GROUP BY conv_id HAVING count(*) FILTER (s <> '') > 0""")
def thread_merge(spark, d):
    """Turns as posts of the thread that is named after the second one."""
    number = F.col("conv_id") * 1000
    posts = table(spark, d, "conversations").select((number + 1).alias("thread"), (number + F.col("turn")).alias("post"), "text", F.length("text").cast("long").alias("chars"))
    return social.merge_threads(posts, "thread", "post", "text", sums=["chars"]).select("thread", "body", "thread_count", "root_id", "title", "chars")


@query("account_cap", f"WITH {ENTRIES} SELECT doc_id FROM (SELECT e.doc_id, e.account, row_number() OVER (PARTITION BY account ORDER BY quality DESC, doc_id) + coalesce(s.stored, 0) AS place FROM entries e LEFT JOIN (SELECT account, count(*) AS stored FROM entries WHERE doc_id % 20 = 0 GROUP BY 1) s USING (account) WHERE e.doc_id % 20 <> 0) WHERE place <= CASE WHEN account % 3 = 0 THEN 5 ELSE 2 END")
def account_cap(spark, d):
    rows = entries(spark, d).select("doc_id", "account", "quality")
    stored = rows.where("doc_id % 20 = 0").groupBy("account").agg(F.count("*").alias("stored"))
    most = F.when(F.col("account") % 3 == 0, 5).otherwise(2)
    return select.capped_with_carry(rows.where("doc_id % 20 <> 0"), "account", stored, most, [F.desc("quality"), "doc_id"]).select("doc_id")


@query("stratum_topk", f"WITH {ENTRIES} SELECT doc_id FROM (SELECT doc_id, content_type, row_number() OVER (PARTITION BY content_type ORDER BY quality DESC, published_ms DESC, doc_id) AS r FROM entries) WHERE content_type <> '论文' OR r <= 10")
def stratum_topk(spark, d):
    rows = entries(spark, d).select("doc_id", "content_type", "quality", "published_ms")
    return clean.top_of_stratum(rows, F.col("content_type") == "论文", 10, [F.desc("quality"), F.desc("published_ms"), "doc_id"]).select("doc_id")


@query("quota_topk", f"""WITH RECURSIVE {ENTRIES}, {SOURCES}, pool AS (
  SELECT e.*, e.doc_id % 4 = 0 AS is_arxiv, row_number() OVER (ORDER BY priority, quality * CASE WHEN e.doc_id % 4 = 0 THEN 0.7 ELSE 1.0 END DESC, published_ms DESC, e.doc_id) AS rn, count(*) FILTER (priority <> 'P0') OVER () AS non_p0
  FROM entries e JOIN sources_dim s USING (source_id) WHERE s.status = 'active' AND published_ms BETWEEN {NOW_MS} - least(168, lookback_hours) * 3600000 AND {NOW_MS} + 172800000
), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS doc_id, 0 AS ok, 0 AS n, 0 AS papers, 0 AS videos, 0 AS podcasts, 0 AS repos, 0 AS arxiv, 0 AS p0, CAST([] AS VARCHAR[]) AS used
  UNION ALL
  SELECT rn, doc_id, ok, n + ok, papers + ok * CAST(content_type = '论文' AS INT), videos + ok * CAST(content_type = '视频' AS INT), podcasts + ok * CAST(content_type = '播客' AS INT), repos + ok * CAST(content_type = 'Github热榜' AS INT),
    arxiv + ok * CAST(is_arxiv AS INT), p0 + ok * CAST(priority = 'P0' AS INT), CASE WHEN ok = 1 THEN list_append(used, source_id) ELSE used END
  FROM (SELECT p.rn, p.doc_id, p.content_type, p.is_arxiv, p.priority, p.source_id, w.n, w.papers, w.videos, w.podcasts, w.repos, w.arxiv, w.p0, w.used,
    CAST(w.n < 30 AND NOT (p.content_type = '论文' AND w.papers >= 4) AND NOT (p.content_type = '视频' AND w.videos >= 4) AND NOT (p.content_type = '播客' AND w.podcasts >= 2) AND NOT (p.content_type = 'Github热榜' AND w.repos >= 5)
      AND NOT (p.is_arxiv AND w.arxiv >= 10) AND NOT (p.priority = 'P0' AND w.p0 >= greatest(0, 30 - least(8, p.non_p0))) AND len(list_filter(w.used, lambda u: u = p.source_id)) < 4 AS INT) AS ok
    FROM walk w JOIN pool p ON p.rn = w.rn + 1)
) SELECT doc_id, CAST(n AS BIGINT) AS pick FROM walk WHERE ok = 1""")
def quota_topk(spark, d):
    met = entries(spark, d).join(F.broadcast(sources_dim(spark).select("source_id", "status", "lookback_hours")), "source_id")  # 25 rows
    pool = met.where((F.col("status") == "active") & clean.in_selection_window(F.col("published_ms"), F.col("lookback_hours"), NOW_MS))
    pool = pool.select("doc_id", "source_id", "priority", "content_type", (F.col("doc_id") % 4 == 0).alias("is_arxiv"), "quality", "published_ms")
    return select.select_candidates(pool, Quotas()).select("doc_id", "pick")


@query("min_slot", f"WITH {ENTRIES}, r AS (SELECT doc_id, content_type, row_number() OVER (ORDER BY quality DESC, doc_id) AS rk FROM entries), s AS (SELECT *, content_type = '视频' AND row_number() OVER (PARTITION BY content_type = '视频' ORDER BY rk) <= 1 AS sure FROM r), c AS (SELECT * FROM s ORDER BY sure DESC, rk LIMIT 10) SELECT doc_id, row_number() OVER (ORDER BY rk) AS place FROM c")
def min_slot(spark, d):
    rows = entries(spark, d).select("doc_id", "content_type", "quality")
    best = rows.orderBy(F.desc("quality"), "doc_id").limit(10).unionByName(rows.where("content_type = '视频'").orderBy(F.desc("quality"), "doc_id").limit(1)).distinct()
    ranked = best.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("quality"), "doc_id")))  # at most 11 rows
    return select.balance(ranked, 10, F.col("content_type") == "视频", 1, "rk").select("doc_id", "place")


@query("final_rank", f"WITH {ENTRIES} SELECT doc_id, CAST(row_number() OVER (ORDER BY quality * w DESC, (doc_id % 5) * w DESC, doc_id) AS BIGINT) AS place FROM (SELECT doc_id, quality, CASE content_type WHEN '视频' THEN 0.9 WHEN '播客' THEN 0.85 ELSE 1.0 END AS w FROM entries) ORDER BY place LIMIT 20")
def final_rank(spark, d):
    weight = scoring.display_weight(F.col("content_type"))
    rows = entries(spark, d).select("doc_id", "quality", "content_type", (F.col("doc_id") % 5).alias("impact"))
    top = rows.orderBy(*select.final_order("quality", weight, ["impact"], "doc_id")).limit(20)
    place = F.row_number().over(Window.orderBy(*select.final_order("quality", weight, ["impact"], "doc_id")))  # 20 rows
    return top.withColumn("place", place.cast("long")).select("doc_id", "place")


@query("enum_sort", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, event_id) AS BIGINT) AS place FROM events")
def enum_sort(spark, d):
    """Events of each user in the order of a list of types; types that it does not name come last."""
    order = Window.partitionBy("user_id").orderBy(reports.enum_rank(F.col("event_type"), ("purchase", "signup", "click")), "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(order).cast("long").alias("place"))


@query("image_dedup", "SELECT url, min(page_id) AS page_id FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS url, page_id FROM pages) GROUP BY url")
def image_dedup(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("url"), "page_id")
    return clean.first_by(rows, "url", ["page_id"])


@query("field_last_wins", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def field_last_wins(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("recent_context", f"WITH {ENTRIES} SELECT account, count(*) AS today FROM entries WHERE published_ms >= {NOW_MS} - 604800000 AND strftime(make_timestamp((published_ms + 28800000) * 1000), '%Y-%m-%d') = '2024-01-30' GROUP BY account")
def recent_context(spark, d):
    recent = entries(spark, d).where((F.col("published_ms") >= NOW_MS - 7 * 86_400_000) & (dates.cn_day(F.col("published_ms")) == "2024-01-30"))
    return recent.groupBy("account").agg(F.count("*").alias("today"))


def headline():
    """The first sentence of an entry's first line."""
    return F.substring_index("title", ". ", 1)


@query("entity_match_pairs", rf"""WITH {ENTRIES}, t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(source_id || ' ' || split_part(title, '. ', 1)), '{similarity.WORDS}'), lambda w: NOT list_contains({list(similarity.STOP_WORDS)}, w) AND (length(w) >= 3 OR regexp_matches(w, '[0-9]'))) AS ws FROM entries),
b AS (SELECT doc_id, list_distinct(ws) AS s, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM t)
SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT *, unnest(g) AS pair FROM b) a JOIN (SELECT *, unnest(g) AS pair FROM b) b ON a.pair = b.pair AND a.doc_id < b.doc_id
WHERE len(list_filter(list_intersect(a.s, b.s), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '[0-9]'))) > 0 AND len(list_filter(list_intersect(a.s, b.s), lambda x: regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^(19|20)[0-9][0-9]$'))) > 0
  AND len(list_intersect(a.s, b.s)) >= 0.55 * len(list_distinct(list_concat(a.s, b.s)))""")
def entity_match_pairs(spark, d):
    lines = entries(spark, d, F.substring_index("text", "\n", 1))
    return events.entity_pairs(lines.select(F.col("doc_id").alias("id"), similarity.anchors(F.concat_ws(" ", "source_id", headline())).alias("words")))


def titled_pages(spark, d):
    """All pages with their title, their first paragraph as the summary, and a source's rank and times by number."""
    n = F.col("page_id")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        text.strip_html(F.regexp_extract("html", r"(?is)<p\b[^>]*>(.*?)</p>", 1)).alias("summary"),
        (START_MS + (n * 7919 % 43200) * 60_000).alias("published_ms"),
        F.concat(F.lit("L"), (n % 4 + 1).cast("string")).alias("tier"),
        F.concat(F.lit("P"), (n % 3).cast("string")).alias("priority"),
        F.length("html").alias("size"),
    )


@query("title_sim_pairs")
def title_sim_pairs(spark, d):
    """Different titles of all pages that are as alike as one event's are."""
    return events.title_pairs(titled_pages(spark, d), "page_id", "title")


@query("event_clusters")
def event_clusters(spark, d):
    rows = titled_pages(spark, d).withColumn("day", dates.cn_day(F.col("published_ms"))).drop("summary")
    clustered = events.cluster(rows, ["day"], "title", ["page_id"])
    prefer = scoring.prefer(F.col("tier"), F.col("priority"), F.lit("文章"), F.col("published_ms"), F.col("size"))
    return events.best_members(clustered, ["day"], prefer, ["page_id"]).select("page_id", "day", "event", "is_best", "members")


@query("event_groups", f"WITH {ENTRIES} SELECT source_id, grp, count(*) AS n FROM (SELECT source_id, doc_id, CASE WHEN tier = 'L1' THEN '官方来源' WHEN content_type = '论文' THEN '交叉验证' WHEN tier IN ('L2', 'L3') THEN '相关报道' ELSE '补充视角' END AS grp FROM entries WHERE doc_id % 6 <> 0) GROUP BY 1, 2")
def event_groups(spark, d):
    link = F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string"), F.lit("/"))).otherwise("")
    rows = entries(spark, d).select("source_id", "doc_id", link.alias("url"), events.event_group(F.lit(False), F.col("tier"), F.col("content_type")).alias("grp"), F.col("source_id").alias("source"))
    return events.group_members(rows, ["source_id"], "source", "url", "grp", ["doc_id"]).select("source_id", "grp", "n")


@query("pool_enrich")
def pool_enrich(spark, d):
    rows = titled_pages(spark, d)  # a brief's signals, every twentieth page, against all pages
    return events.pool_matches(rows.where("page_id % 20 = 0"), rows, "page_id", "title", "summary", "published_ms")


@query("consume_once")
def consume_once(spark, d):
    """All pages as the signals of one brief, by number: each takes in the later ones of its event."""
    rows = titled_pages(spark, d).withColumn("place", F.col("page_id"))
    return events.taken_in(rows, "page_id", "place", "title", "summary", "published_ms")


@query("novelty_band")
def novelty_band(spark, d):
    """Every twentieth item against all other ones."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = social.nearest(items.where("id % 20 = 0"), items)
    return found.select("id", scoring.novelty_points(F.col("similarity")).alias("points"))


@query("union_sources", "SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1")
def union_sources(spark, d):
    parts = [table(spark, d, t).select(F.lit(t).alias("kind"), F.lit(1).alias(t)) for t in ("documents", "pages", "conversations")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"))


@query("key_union", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id FROM labels")
def key_union(spark, d):
    return table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id").union(table(spark, d, "labels").select("doc_id")).distinct()


@query("key_except", "SELECT event_id AS id FROM events EXCEPT SELECT doc_id FROM documents")
def key_except(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id")).subtract(table(spark, d, "documents").select("doc_id"))


@query("token_intersect", "SELECT a.item_id AS a, b.item_id AS b, CAST(len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' ')))) AS BIGINT) AS shared FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def token_intersect(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    a, b = items.alias("a"), items.withColumn("item_id", F.col("item_id") - 1).alias("b")
    return a.join(b, F.col("a.item_id") == F.col("b.item_id")).select(F.col("a.item_id").alias("a"), (F.col("b.item_id") + 1).alias("b"), F.size(F.array_intersect("a.w", "b.w")).cast("long").alias("shared"))


@query("section_fill", "SELECT doc_id, line_no, last_value(CASE WHEN line_no % 4 = 0 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)")
def section_fill(spark, d):
    """Each line's section: the last heading at or before it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", F.col("at").cast("long").alias("line_no"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("section", F.last(F.when(F.col("line_no") % 4 == 0, F.col("line_no")), ignorenulls=True).over(order))


@query("status_sync", f"WITH {SOURCES} SELECT s.source_id, c.c_name AS name FROM sources_dim s LEFT JOIN customer c ON c.c_custkey = s.n")
def status_sync(spark, d):
    catalog = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("n"), F.col("c_name").alias("name"))
    return sources_dim(spark).join(catalog, "n", "left").select("source_id", "name")


@query("backfill_candidates", f"WITH {ENTRIES} SELECT doc_id, abs(published_ms - (published_ms + (doc_id % 9 - 4) * 3600000)) <= 10800000 AS candidate FROM entries")
def backfill_candidates(spark, d):
    collected = F.col("published_ms") + (F.col("doc_id") % 9 - 4) * 3_600_000
    return entries(spark, d).select("doc_id", (F.abs(F.col("published_ms") - collected) <= 10_800_000).alias("candidate"))


@query("fulltext_backfill", f"WITH {ENTRIES} SELECT doc_id FROM (SELECT doc_id, length(body) < 300 AS needs FROM entries) ORDER BY needs DESC, doc_id LIMIT 40")
def fulltext_backfill(spark, d):
    return entries(spark, d).select("doc_id", (F.length("body") < 300).alias("needs")).orderBy(F.desc("needs"), "doc_id").limit(40).select("doc_id")


@query("precision_recall", "SELECT count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (toxic = 0), 0) AS precision, count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0) AS recall FROM labels")
def precision_recall(spark, d):
    return reports.precision_recall(table(spark, d, "labels"), F.col("toxic") == 0, F.col("quality") == 1)


@query("trending_keep", f"WITH {ENTRIES} SELECT doc_id, CASE WHEN age <= 7 THEN NOT (up > 0 AND up < 5) WHEN age > 30 THEN false ELSE up >= 100 END AS keep, age > 7 AND age <= 30 AND up >= 100 AS heat_keep FROM (SELECT doc_id, doc_id % 150 AS up, ({NOW_MS} - published_ms) / 86400000.0 AS age FROM entries)")
def trending_keep(spark, d):
    out = clean.keep_trending(F.col("published_ms"), F.col("doc_id") % 150, F.lit(0), 5, NOW_MS)
    return entries(spark, d).select("doc_id", out["keep"].alias("keep"), out["heat_keep"].alias("heat_keep"))


@query("repo_list", "SELECT p_partkey FROM (SELECT p_partkey, p_retailprice, p_partkey % 2 = 0 AS is_new, row_number() OVER (PARTITION BY p_partkey % 2 = 0 ORDER BY p_retailprice DESC, p_partkey) AS nth FROM part) WHERE NOT is_new OR nth <= 6 ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def repo_list(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return select.repo_list(parts, 20, [F.desc("p_retailprice"), "p_partkey"], F.col("p_partkey") % 2 == 0).select("p_partkey")


@query("evidence_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS nth FROM conversations) WHERE total <= 1500 OR nth = 1")
def evidence_budget(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return clean.within_budget(rows, "conv_id", [F.desc("size"), "turn"], "size", 1500).select("conv_id", "turn")


# Plain relational coverage beyond the reference's own operators.


@query("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("rollup_sales", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("lag_lead", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lag_lead(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS total FROM events")
def rows_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))


@query("asof_orders", "SELECT e.event_id, max(o.o_orderkey) AS o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderkey <= e.event_id GROUP BY 1")
def asof_orders(spark, d):
    """The last order of the user at or before each event: both sides in one order per user, carried forward."""
    left = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("at", "side")
    met = left.unionByName(right).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return met.where("side = 1 AND o_orderkey IS NOT NULL").select("event_id", "o_orderkey")
